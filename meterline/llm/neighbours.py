"""Approximate nearest neighbours with vantage-point trees, one per shard.

Vectors are dealt into shards of about ``SHARD`` rows by a hash of their id; each shard becomes one row that holds its tree.
A node has a vantage point and two children, the nearer and the farther half of its points, with the smallest and largest
distance of each half to the vantage point. By the triangle inequality no point of a child is nearer to a query than the gap between the
query's own distance and that range. A child is skipped if ``factor`` times the gap exceeds the k-th best distance so far: with factor
1 the search is exact, larger factors skip more.

Queries travel in blocks, every block meets every shard once, and a block walks a tree together: numpy handles all of its
queries that are still interested in a node at a time. Points are split by rank, so many equal vectors don't unbalance a tree.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.session import ready_for_checkpoint

from .common import BATCH_KEY, ready, table

SHARD = 2048
BLOCK = 512
LEAF = 48
K = 10
FACTOR = 1.0
EVERY = 100


class Tree:
    """Points in tree order and the nodes: begin, end, children (0: leaf), ranges of the children's distances."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, places: np.ndarray, ranges: np.ndarray):
        self.ids, self.points, self.places, self.ranges = ids, points, places, ranges

    @classmethod
    def of(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        wide = points.astype(np.float64)
        places: list[list[int]] = []
        ranges: list[list[float]] = []

        def grow(begin: int, end: int) -> int:
            node = len(places)
            places.append([begin, end, 0, 0])
            ranges.append([0.0] * 4)
            if end - begin <= leaf:
                return node
            own = order[begin:end]
            # the vantage point: the one farthest from the first, as far points part the rest best
            start = np.sqrt(((wide[own] - wide[own[0]]) ** 2).sum(1))
            top = int(np.argmax(start))
            own[[0, top]] = own[[top, 0]]
            away = np.sqrt(((wide[own[1:]] - wide[own[0]]) ** 2).sum(1))
            by = np.argsort(away, kind="stable")
            order[begin + 1 : end] = own[1:][by]
            away = away[by]
            half = len(away) // 2
            ranges[node] = [away[0], away[half - 1], away[half], away[-1]]
            near = grow(begin + 1, begin + 1 + half)
            places[node][2:] = [near, grow(begin + 1 + half, end)]
            return node

        if len(ids):
            grow(0, len(ids))
        return cls(ids[order], points[order], np.array(places, np.int64).reshape(-1, 4), np.array(ranges).reshape(-1, 4))

    def packed(self) -> bytes:
        np.savez(file := io.BytesIO(), ids=self.ids, points=self.points, places=self.places, ranges=self.ranges)
        return file.getvalue()

    @classmethod
    def unpacked(cls, content: bytes) -> Tree:
        with np.load(io.BytesIO(content)) as z:
            return cls(z["ids"], z["points"], z["places"], z["ranges"])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        """(distances, ids) of the k nearest of each query; infinite distances where there are fewer."""
        n, last = len(queries), len(self.ids)
        queries = queries.astype(np.float64)
        best = np.full((n, k), np.inf)
        where = np.full((n, k), last)
        names = np.append(self.ids, np.iinfo(np.int64).max)

        def offer(q: np.ndarray, distance: np.ndarray, begin: int, end: int) -> None:
            distance = np.where(query_ids[q][:, None] == self.ids[None, begin:end], np.inf, distance)
            d = np.concatenate([best[q], distance], 1)
            i = np.concatenate([where[q], np.broadcast_to(np.arange(begin, end), distance.shape)], 1)
            i = np.where(np.isinf(d), last, i)
            top = np.lexsort((names[i], d), axis=1)[:, :k]
            best[q], where[q] = np.take_along_axis(d, top, 1), np.take_along_axis(i, top, 1)

        def distances(q: np.ndarray, begin: int, end: int) -> np.ndarray:
            points = self.points[begin:end].astype(np.float64)
            out = np.empty((len(q), len(points)))
            for at in range(0, len(q), 64):
                part = queries[q[at : at + 64]]
                out[at : at + 64] = np.sqrt(((part[:, None, :] - points[None]) ** 2).sum(2))
            return out

        def visit(node: int, q: np.ndarray) -> None:
            if not len(q):
                return
            begin, end, near, far = self.places[node]
            if not near:
                offer(q, distances(q, begin, end), begin, end)
                return
            d = distances(q, begin, begin + 1)
            offer(q, d, begin, begin + 1)
            d = d[:, 0]
            near_low, near_high, far_low, far_high = self.ranges[node]
            near_gap = np.maximum(np.maximum(d - near_high, near_low - d), 0.0)
            far_gap = np.maximum(np.maximum(d - far_high, far_low - d), 0.0)
            near_first = d <= (near_high + far_low) / 2

            def wanted(which: np.ndarray, gap: np.ndarray) -> np.ndarray:
                # the margin covers rounding of the stored distances
                return which & (gap * factor <= best[q, -1] * (1 + 1e-9) + 1e-12)

            visit(near, q[wanted(near_first, near_gap)])
            visit(far, q[wanted(np.ones(len(q), bool), far_gap)])
            visit(near, q[wanted(~near_first, near_gap)])

        if len(self.places):
            visit(0, np.arange(n))
            # the found distances once more, one component after the other, as SQL adds them
            total, points = np.zeros((n, k)), self.points[np.minimum(where, last - 1)].astype(np.float64)
            for c in range(queries.shape[1]):
                gap = queries[:, c, None] - points[:, :, c]
                total += gap * gap
            best = np.where(where < last, np.sqrt(total), np.inf)
        return best, np.where(where < last, names[where], -1)


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """``dim, shard, shards, tree`` over ``vectors(vec_id, vec)``; every usable row is in one tree."""
    counts = {r["dim"]: r["count"] for r in vectors.groupBy(F.size("vec").alias("dim")).count().collect()}
    per_dim = {d: -(-n // shard) for d, n in counts.items()}
    shards = F.coalesce(*[F.when(F.size("vec") == d, F.lit(s)) for d, s in per_dim.items()], F.lit(1))
    dealt = vectors.withColumn("dim", F.size("vec")).withColumn("shards", shards)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def grow(rows: pa.Table) -> pa.Table:
        tree = Tree.of(rows["vec_id"].to_numpy(), _matrix(rows["vec"]))
        first = rows.slice(0, 1)
        return pa.table(
            [first["dim"], first["shard"], first["shards"], pa.chunked_array([pa.array([tree.packed()], pa.binary())])],
            ["dim", "shard", "shards", "tree"],
        )

    return dealt.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard int, shards int, tree binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each of ``queries(vec_id, vec)`` among ``vectors`` (same columns).

    score is the Euclidean distance in double precision, nearest first, ties to the smaller vec_id; a query's own id is no
    candidate; fewer candidates give fewer rows. Null, zero and non-finite vectors take no part; vectors of another dimension
    are no candidates. Repeated rows count as candidates of their own; empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ready(spark)
    ready_for_checkpoint(spark)
    data = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).select("vec_id", "vec")
    asked = queries.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).select("vec_id", "vec")
    trees = build(data, shard)
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = (
        asked.withColumn("dim", F.size("vec"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
        .groupBy("dim", "block")
        .agg(F.collect_list("vec_id").alias("ids"), F.collect_list("vec").alias("vecs"))
    )
    spread = trees.groupBy("dim").agg(F.first("shards").alias("_n"))
    asked = asked.join(spread, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = asked.join(trees, ["dim", "shard"]).select("ids", "vecs", "tree")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(len(part)):
                ids = part.column(0)[row].values.to_numpy()
                points = _matrix(part.column(1)[row].values)
                tree = Tree.unpacked(part.column(2)[row].as_py())
                distance, found = tree.search(ids, points, k, factor)
                real = np.isfinite(distance.ravel())
                yield pa.record_batch(
                    [pa.array(np.repeat(ids, k)[real]), pa.array(found.ravel()[real]), pa.array(distance.ravel()[real])],
                    ["query_id", "vec_id", "score"],
                )

    before = spark.conf.get(BATCH_KEY, "10000")
    spark.conf.set(BATCH_KEY, "16")  # a row holds a whole tree
    try:
        found = met.mapInArrow(search, "query_id long, vec_id long, score double").checkpoint()
    finally:
        spark.conf.set(BATCH_KEY, before)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q.e, v.e)])) AS score
  FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
