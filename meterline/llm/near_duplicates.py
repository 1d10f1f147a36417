"""Near-duplicate groups: bottom-k sketches, inverted lists of retained values, and exact Jaccard similarity.

A document's set holds the hashes of its word shingles; its sketch is the ``K`` smallest of them, all from one hash function.

1. Documents with equal sets form a class, and its smallest id stands for it from here on.
2. Inverted lists. The key of a list is a run of three neighbouring retained values. Of two linked sets at least four in five values of the
   union are shared, so their sketches share runs: of 64 values with fewer than ``DROPPED + 1`` shared runs there is one pair in three
   million at the threshold itself, and fewer above it. A sketch may thus leave out its ``DROPPED`` most frequent runs, which are those of
   passages that many documents hold. Sets that are retained whole leave out none; they always share a run (of two for sets of four or five).
   Single retained values would need no such care, but at scale most of them occur in unrelated documents too.
3. Star. The smallest id of a list is its pivot, and every member is compared with it alone: first the similarity over the
   union of the two sketches, then the exact one over the whole texts. A group of n near copies costs n comparisons.
   The sketch test lets a pair through down to ``MARGIN`` below the threshold: of 64 union values a pair at exactly 80 percent
   falls below 0.45 with a chance of 1.8e-10 (binomial), so with the runs above at most about 3.4e-7 of the linked pairs at
   the threshold can be missed, and fewer above it.
4. Rest. The members of a pivot's lists are a block. Members outside the block's largest component are compared with the others of the block, if
   in another component: again first by sketch, then exactly. Blocks are cut into chunks, every pair of chunks is a piece of work of its own,
   and pairs are only counted inside it; what comes out is at most one link per document and component.
5. Components by alternating large and small stars.

Nothing is capped; no list of pairs of a whole group is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.session import ready_for_checkpoint

from .common import fresh_name, ready, table
from .hashing import mixed, shingle_sets

K = 64
DROPPED = 4
WORDS = 5
PERCENT = 80
MARGIN = 0.35
CHUNK = 1000
CHUNK_SHINGLES = 300_000
ROWS_AT_ONCE = 4000
MATCHES_AT_ONCE = 2_000_000
SENT_IDS = 1_000_000
EDGES_IN_TASK = 200_000
SKETCH = "struct<n:long,a:long,b:long,sketch:array<long>>"


def sketch_column(words: int, text: str = "text") -> Column:
    """Size, two order-free digests and the sorted bottom-k of a text's shingle set."""

    @F.arrow_udf(SKETCH)
    def sketch(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            n, a, b, kept = [], [], [], []
            for own in shingle_sets(texts, words):
                n.append(len(own))
                a.append(int(mixed(own + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                kept.append(own[:K].view(np.int64))
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], ["n", "a", "b", "sketch"]
            )

    return sketch.asNondeterministic()(F.col(text))


def runs(n: Column, sketch: Column) -> Column:
    """Keys of the inverted lists: hashes of runs of three retained values; of two as well for sets of four and five."""

    def of(length: int) -> Column:
        places = F.sequence(F.lit(0), F.size(sketch) - length)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(sketch, i + j) for j in range(length)]))

    # two different sets of fewer than four values can't be linked
    return F.when(n > 5, of(3)).when(n > 3, F.concat(of(3), of(2)))


def similar_sizes(m: Column, n: Column, percent: int) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def union_estimate(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of the parts of two sorted sketches up to the largest value that both would retain."""
    if not len(x) or not len(y):
        return 0.0
    tops = [s[-1] for s in (x, y) if len(s) == K]
    if tops:
        x, y = x[x <= min(tops)], y[y <= min(tops)]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of the left sets, the first index and the matrix (run x right) of the sizes of the intersections."""
    values = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    low = [np.searchsorted(values, s, "left") for s in left]
    high = [np.searchsorted(values, s, "right") for s in left]
    costs = np.array([int((h - lo).sum()) for lo, h in zip(low, high)])
    begin = 0
    while begin < len(left):
        end, cost = begin + 1, costs[begin]
        while end < len(left) and cost + costs[end] <= MATCHES_AT_ONCE and end - begin < 256:
            cost += costs[end]
            end += 1
        lo, hi = np.concatenate(low[begin:end]), np.concatenate(high[begin:end])
        row = np.repeat(np.arange(end - begin), [len(x) for x in low[begin:end]])
        sizes = hi - lo
        place = np.repeat(lo - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
        cell = np.repeat(row, sizes) * len(right) + owner[place]
        yield begin, np.bincount(cell, minlength=(end - begin) * len(right)).reshape(end - begin, len(right))
        begin = end


def estimates(shared: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The union estimate of every pair, from the counts of shared values; whole sketches are taken as they are."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    top_l = np.array([s[-1] if len(s) == K else none for s in left], np.uint64)
    top_r = np.array([s[-1] if len(s) == K else none for s in right], np.uint64)
    flat_r = np.concatenate(right)
    begin_r = np.concatenate(([0], np.cumsum([len(s) for s in right])[:-1]))
    out = np.empty(shared.shape)
    for i, own in enumerate(left):
        limit = np.minimum(top_l[i], top_r)
        mine = np.searchsorted(own, limit, "right")
        theirs = np.add.reduceat(flat_r <= top_l[i], begin_r)
        out[i] = shared[i] / np.maximum(mine + theirs - shared[i], 1)
    return out


def exact_column(words: int, percent: int) -> Column:
    """Whether the sets of text_a and text_b are linked."""

    @F.arrow_udf("boolean")
    def linked(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts:
            out = []
            for x, y in zip(shingle_sets(left, words), shingle_sets(right, words)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.array(out, pa.bool_())

    return linked.asNondeterministic()(F.col("text_a"), F.col("text_b"))


def estimate_column() -> Column:
    @F.arrow_udf("double")
    def estimate(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts:
            yield pa.array([union_estimate(_set(x), _set(y)) for x, y in zip(left, right)], pa.float64())

    return estimate.asNondeterministic()(F.col("sketch_a"), F.col("sketch_b"))


def _set(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).view(np.uint64)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node that can be reached) of all nodes of ``edges(a, b)``, which are read twice.

    Edges are few beside documents, so they are kept in as many partitions as their number asks for.
    """
    few = -(-edges.count() // EDGES_IN_TASK) or 1
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    stars = pairs.distinct().coalesce(few).checkpoint()
    before = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        stars = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct().coalesce(few).checkpoint()


def dealt(members: DataFrame, weight: Column, most: int, at_once: int) -> DataFrame:
    """Rows of ``members(block, minor, ...)`` for every pair of chunks they take part in, as ``side, lc, rc, job``.

    A block's members are dealt into as many chunks as their weight asks for; minors stand on the left side against every chunk, all
    members on the right side against every chunk of minors. ``job`` gathers small pieces of work into even groups of about ``at_once``.
    Members meet the numbers of their block once, for both sides, and the weight of all pieces comes from those numbers alone.
    """
    chunks = lambda w: F.greatest(F.ceil(F.col(w) / F.lit(most)), F.lit(1)).cast("int")
    per_block = (
        members.groupBy("block")
        .agg(F.sum(weight).alias("_all"), F.coalesce(F.sum(F.when(F.col("minor"), weight)), F.lit(0)).alias("_minors"))
        .select("block", chunks("_all").alias("chunks"), chunks("_minors").alias("minor_chunks"), "_all", "_minors")
        .checkpoint()  # cut off, so that a large block can be split when its members meet it
    )
    total = per_block.agg(F.sum(F.expr("_minors * chunks + _all * minor_chunks"))).first()[0] or 0
    jobs = max(1, -(-int(total) // at_once))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    piece = lambda side, lc, rc: F.struct(F.lit(side).alias("side"), lc.alias("lc"), rc.alias("rc"))
    every = lambda n, of: F.transform(F.sequence(F.lit(0), F.col(n) - 1), of)
    left = every("chunks", lambda c: piece(0, own("minor_chunks"), c))
    right = every("minor_chunks", lambda c: piece(1, c, own("chunks")))
    rows = members.join(per_block.drop("_all", "_minors"), "block")
    rows = rows.select(*members.columns, F.inline(F.when(F.col("minor"), F.concat(left, right)).otherwise(right)))
    return rows.withColumn("job", F.pmod(F.xxhash64("block", "lc", "rc"), F.lit(jobs)))


def pieces_of_work(rows: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Left and right rows of each (block, lc, rc) of a group."""
    rows = rows.sort_by([("block", "ascending"), ("lc", "ascending"), ("rc", "ascending"), ("side", "ascending")])
    keys = np.stack([rows[c].to_numpy() for c in ("block", "lc", "rc")], 1)
    side = rows["side"].to_numpy()
    cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], 1)) + 1
    for begin, end in zip([0, *cuts], [*cuts, len(rows)]):
        middle = begin + int(np.searchsorted(side[begin:end], 1))
        if middle > begin and end > middle:
            yield rows.slice(begin, middle - begin), rows.slice(middle, end - middle)


def comparable(left: pa.Table, right: pa.Table, percent: int) -> np.ndarray:
    """Pairs of different components and similar sizes."""
    m, n = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
    apart = left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
    return apart & (np.minimum(m, n) * 100 >= np.maximum(m, n) * percent)


def hopeful(members: DataFrame, percent: int) -> DataFrame:
    """Of the members of blocks, those that some other may be linked with, by the estimate."""
    least = percent / 100 - MARGIN

    def look(rows: pa.Table) -> pa.Table:
        blocks, reps = [], []
        for left, right in pieces_of_work(rows):
            x, y = ([_set(s) for s in t["sketch"].combine_chunks()] for t in (left, right))
            open_ = comparable(left, right, percent)
            hit_l, hit_r = np.zeros(len(x), bool), np.zeros(len(y), bool)
            for at, shared in shared_counts(x, y):
                end = at + len(shared)
                good = open_[at:end] & (estimates(shared, x[at:end], y) >= least)
                hit_l[at:end] |= good.any(1)
                hit_r |= good.any(0)
            for t, hit in ((left, hit_l), (right, hit_r)):
                reps.append(t["rep"].to_numpy()[hit])
                blocks.append(t["block"].to_numpy()[hit])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"block": np.concatenate(blocks + empty), "rep": np.concatenate(reps + empty)})

    rows = dealt(members, F.lit(1), CHUNK, ROWS_AT_ONCE)
    found = rows.groupBy("job").applyInArrow(look, "block long, rep long").distinct()
    return members.drop("sketch").join(found, ["block", "rep"])


def rest_links(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Exact links ``a, b`` between members of blocks in different components; one for each left document and component."""

    def look(rows: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for left, right in pieces_of_work(rows):
            x, y = (list(shingle_sets(t["text"], words)) for t in (left, right))
            open_ = comparable(left, right, percent)
            m, n = left["n"].to_numpy(), right["n"].to_numpy()
            comp, ids, other = right["comp"].to_numpy(), left["rep"].to_numpy(), right["rep"].to_numpy()
            for at, shared in shared_counts(x, y):
                end = at + len(shared)
                good = open_[at:end] & (100 * shared >= percent * (m[at:end, None] + n[None, :] - shared)) & (shared > 0)
                for i in np.flatnonzero(good.any(1)):
                    linked = np.flatnonzero(good[i])
                    _, first = np.unique(comp[linked], return_index=True)
                    b.append(other[linked[first]])
                    a.append(np.full(len(first), ids[at + i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    rows = dealt(members, F.col("n"), CHUNK_SHINGLES, 2 * CHUNK_SHINGLES)
    rows = rows.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    return rows.groupBy("job").applyInArrow(look, "a long, b long")


def in_components(rows: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of a node; nodes without links are their own."""
    found = comps.select(F.col("node").alias("_node"), F.col("component").alias("_comp"))
    return rows.join(found, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_comp", node)).drop("_node", "_comp")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the documents with an ``id``. Up to ``SENT_IDS`` ids go to the scan, so that other texts aren't shuffled."""
    ids = ids.distinct()
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text)``.

    ``percent`` is at least 80. Documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles (fewer words: the whole
    sequence is the only shingle). component_id is the smallest id that links reach; kept marks the document of that id.
    Null, empty and blank texts have empty sets and are linked with nothing. Rows with the same id are one document and share its
    component. A null id is in no group, has a null component_id and is kept. An empty table gives no rows; other columns are ignored.
    """
    if percent < 80:
        raise ValueError("runs of retained values need a similarity of 80 percent or more")
    spark = docs.sparkSession
    ready(spark)
    ready_for_checkpoint(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = docs.withColumn("_s", sketch_column(words)).select("doc_id", "_s.n", "_s.a", "_s.b", "_s.sketch").checkpoint()
    classes = (
        sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
        .groupBy("n", "a", "b")
        .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
        .checkpoint()
    )
    # inverted lists of runs of retained values
    values = classes.select("rep", "n", F.explode(runs(F.col("n"), F.col("sketch"))).alias("h"))
    shared = values.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    frequent = Window.partitionBy("rep").orderBy(F.desc("df"), "h")
    listed = (
        values.join(shared, "h")
        .withColumn("_nth", F.row_number().over(frequent))
        .filter((F.col("_nth") > DROPPED) | (F.col("n") * 100 <= K * percent))
        .select("h", "rep", "n")
        .checkpoint()
    )
    pivots = listed.groupBy("h").agg(F.min("rep").alias("block"))
    star = listed.join(pivots, "h").select("block", "rep", "n").distinct().checkpoint()
    # every member against its pivot
    a = classes.select(F.col("rep").alias("block"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = classes.select("rep", F.col("sketch").alias("sketch_b"))
    near = (
        star.filter("rep <> block")
        .join(a, "block")
        .filter(similar_sizes(F.col("n"), F.col("n_a"), percent))
        .join(b, "rep")
        .withColumn("_e", estimate_column())
        .filter(F.col("_e") >= percent / 100 - MARGIN)
        .select(F.col("block").alias("a"), F.col("rep").alias("b"))
        .checkpoint()
    )
    texts = texts_of(docs, near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))))
    links = (
        near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .withColumn("_l", exact_column(words, percent))
        .filter("_l")
        .select("a", "b")
        .checkpoint()
    )
    # members of different components within a block
    comps = components(links)
    placed = in_components(star, comps, "rep", "comp")
    sizes = placed.groupBy("block", "comp").agg(F.count("*").alias("_c"))
    largest = sizes.groupBy("block").agg(
        F.max_by("comp", F.struct("_c", -F.col("comp"))).alias("main"), F.count("*").alias("_comps"), F.sum("_c").alias("_all")
    )
    open_ = (
        placed.join(largest.filter("_comps > 1 AND _all > 2"), "block")
        .withColumn("minor", F.col("comp") != F.col("main"))
        .select("block", "rep", "n", "comp", "minor")
        .join(b.withColumnRenamed("sketch_b", "sketch"), "rep")
        .checkpoint()
    )
    left = hopeful(open_, percent).checkpoint()
    more = rest_links(left, texts_of(docs, left.select(F.col("rep").alias("id"))), words, percent)
    final = components(links.unionByName(more.checkpoint()))
    of_class = in_components(classes.select("n", "a", "b", "rep"), final, "rep", "comp")
    of_class = of_class.select(*[F.col(c).alias(f"_{c}") for c in ("n", "a", "b")], "comp")
    same = (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return (
        sets.drop("sketch")
        .join(of_class, same, "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), words=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id (null ids after all ids; of rows with
    one id, the first in the order of the scan).

    Every row takes part, null ids and repeated rows included: rows are numbered by their place in the scan of ``docs``
    (a table read from files, so a task that runs again numbers them alike), groups are found over those numbers, and the
    winner of each group is chosen by (id, number) over narrow rows. Exact repeated rows are one group, so one of them
    stays. Rows without words link with nothing and stay. Columns stay as they were.
    """
    ready_for_checkpoint(spark)
    row = fresh_name(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = groups(numbered.select(F.col(row).alias("doc_id"), "text"))
    order = numbered.select(
        F.col(row).alias("_m"), F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r")).alias("_o"))
    winners = (
        found.select(F.col("doc_id").alias("_m"), "component_id").join(order, "_m")
        .groupBy("component_id").agg(F.min("_o").alias("_w")).select(F.col("_w.r").alias("_keep"))
    )
    return numbered.join(winners, numbered[row] == winners["_keep"], "left_semi").drop(row)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 2 THEN [words]
                                 ELSE [words[i:i + 1] for i in range(1, len(words))] END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reached) AS component_id, d.doc_id = min(r.reached) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
