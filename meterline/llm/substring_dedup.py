"""Substring dedup: Rabin-Karp hashes of every window of 20 words, counted in Spark, merged into maximal removal intervals.

Exact copies are settled per text first: rows are grouped by the SHA-256 of their text, and only the first row of each
text (the representative) is cut into windows. A later copy has every window of its representative at the same start,
so all of its words in windows go; a row with the same id and text as the representative is the same document.

Each task hashes the words of its representatives (siphash of the word) and turns them into a polynomial (Rabin-Karp)
hash of every window of ``WINDOW`` consecutive words, from prefix sums modulo 2**64. Windows are ordered by their place
(the representative's rank, then start); ranks come from one sorted, checkpointed row per distinct text. Before the shuffle
each task keeps, per hash, only its first place and reports the later places as removed (a map-side combine, so a
window shared by many documents costs one entry per task); the rest travels packed, bucketed by hash, in one shuffle:
per bucket the entries sorted by place, as zstd-compressed arrays (ranks and starts are nearly constant steps there).
Each bucket sorts its entries by hash and place: every place after a hash's first is removed. The removed windows of a
document are checked against its own window hashes and merged into maximal intervals in a last pass. Texts cross the
network once, zstd-compressed, into a table in the shared folder that both passes over them read.

Order of places: smaller doc_id first, null ids after all ids; rows with the same id and different texts are ordered
by the SHA-256 of the text. Decisions are taken on the input, not on what is left. A 64-bit window hash makes a false
removal possible only when two different windows share it: about (distinct windows)^2 / 2**65 pairs.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from meterline.session import ready_for_checkpoint, scratch_path

from .common import ready, table

# Fixed values of the contract.
WINDOW = 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")

KEY = "substring-dedup1"  # siphash key of the word hashes
BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
PACKED = "route int, removed boolean, n int, blob binary"
REMOVED = "r long, s int, h long"
PER_TEXT = "rank long, n_words long, n_removed long, kept_sha256 string"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
LEVEL = 3  # zstd level of packed texts and windows
BUCKET_ENTRIES = 2_000_000  # windows per bucket of the shuffle, about 40 MB in a task at once
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def window_hashes(words: list[str]) -> np.ndarray:
    """Rabin-Karp hash of every window of ``WINDOW`` words, as int64: ``sum(w[s + j] * BASE**j)``, wrapping at 2**64."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    w = pd.util.hash_array(np.array(words, dtype=object), hash_key=KEY, categorize=False)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, np.uint64)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - WINDOW, pow(BASE, -1, 1 << 64), np.uint64)]),
                          dtype=np.uint64)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(w * powers, dtype=np.uint64)])
        sums = (prefix[WINDOW:] - prefix[:-WINDOW]) * back
    return sums.view(np.int64)


def _firsts(h: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries (hash, rank, start): a mask of the first place of each hash (one entry per tie) and of later places."""
    order = np.lexsort((s, r, h))
    h, r, s = h[order], r[order], s[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    first_r, first_s = r[new][group], s[new][group]
    later = (r > first_r) | ((r == first_r) & (s > first_s))
    same = np.ones(len(h), bool)
    same[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    keep = ~later & same
    first, gone = np.zeros(len(h), bool), np.zeros(len(h), bool)
    first[order[keep]] = True
    gone[order[later]] = True
    return first, gone


def pack(h: np.ndarray, r: np.ndarray, s: np.ndarray) -> bytes:
    """Entries sorted by place, as zstd of hashes, rank steps and start steps."""
    order = np.lexsort((s, r))
    h, r, s = h[order], r[order], s[order].astype(np.int64)
    raw = h.tobytes() + np.diff(r, prepend=0).tobytes() + np.diff(s, prepend=0).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def unpack(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
    return raw[:n], np.cumsum(raw[n : 2 * n]), np.cumsum(raw[2 * n :]).astype(np.int32)


def _text(z) -> str | None:
    return None if z is None else zstandard.ZstdDecompressor().decompress(z).decode("utf-8")


@F.pandas_udf(BinaryType())
def _zstd(text: pd.Series) -> pd.Series:
    """Texts as zstd frames, so that they cross the network and sit in the shared folder at a third of their size."""
    zc = zstandard.ZstdCompressor(level=LEVEL)
    return text.map(lambda t: None if not isinstance(t, str) else zc.compress(t.encode("utf-8")))


def _packed(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hs, rs, ss = [], [], []
            for rank, z in zip(batch["rank"], batch["z"]):
                h = window_hashes(words_of(_text(z)))
                hs.append(h)
                rs.append(np.full(len(h), rank, np.int64))
                ss.append(np.arange(len(h), dtype=np.int32))
            if not hs:
                continue
            h, r, s = np.concatenate(hs), np.concatenate(rs), np.concatenate(ss)
            if not len(h):
                continue
            first, gone = _firsts(h, r, s)
            route = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            rows = []
            for removed, mask in ((False, first), (True, gone)):
                if not mask.any():
                    continue
                hm, rm, sm, bm = h[mask], r[mask], s[mask], route[mask]
                order = np.argsort(bm, kind="stable")
                hm, rm, sm, bm = hm[order], rm[order], sm[order], bm[order]
                cuts = np.flatnonzero(np.diff(bm)) + 1
                for part_h, part_r, part_s, part_b in zip(*(np.split(x, cuts) for x in (hm, rm, sm, bm))):
                    rows.append((int(part_b[0]), removed, len(part_h), pack(part_h, part_r, part_s)))
            yield pd.DataFrame(rows, columns=["route", "removed", "n", "blob"])

    return run


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries arrive sorted by bucket; each bucket in turn: every place after its hash's first one is removed.

    Removals reported by the map side pass through. Only one bucket's entries are held at a time.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    current = None

    def close():
        if held:
            h, r, s = (np.concatenate([x[i] for x in held]) for i in range(3))
            _, gone = _firsts(h, r, s)
            yield pd.DataFrame({"r": r[gone], "s": s[gone], "h": h[gone]})
        held.clear()

    for batch in batches:
        for route, removed, n, blob in zip(batch["route"], batch["removed"], batch["n"], batch["blob"]):
            h, r, s = unpack(blob, int(n))
            if removed:
                yield pd.DataFrame({"r": r, "s": s, "h": h})
                continue
            if route != current:
                yield from close()
                current = route
            held.append((h, r, s))
    yield from close()


def _per_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of representatives: removals checked against the text's own window hashes, merged into intervals."""
    for batch in batches:
        rows = []
        for rank, z, starts, hashes in zip(batch["rank"], batch["z"], batch["starts"], batch["hashes"]):
            words = words_of(_text(z))
            gone = np.zeros(len(words), bool)
            if len(words) >= WINDOW and starts is not None and len(starts):
                own = window_hashes(words)
                starts = np.asarray(starts, np.int64)
                sure = starts[own[starts] == np.asarray(hashes, np.int64)]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, sure, 1)
                np.add.at(edge, sure + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
            kept = " ".join(w for w, g in zip(words, gone) if not g) if gone.any() else " ".join(words)
            rows.append((int(rank), len(words), int(gone.sum()), hashlib.sha256(kept.encode("utf-8")).hexdigest()))
        yield pd.DataFrame(rows, columns=["rank", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and the hash of the kept words joined by one space.

    Only ``doc_id`` and ``text`` are read. Null or empty text, or fewer than 20 words: nothing removed. Repeated rows give
    equal results. Every text is read whole; nothing is sampled or cut.
    """
    spark = docs.sparkSession
    ready(spark)
    ready_for_checkpoint(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))  # at most one too many
    texts = rows.groupBy("sha").agg(F.min(place).alias("first"), F.max(words).alias("n_est"))
    # one rank per distinct text, in the order of places; written, so every later step sees the same ranks
    texts = texts.orderBy(F.col("first.n"), F.col("first.d"), "sha").withColumn("rank", F.monotonically_increasing_id())
    texts = texts.checkpoint()
    windows = texts.agg(F.sum(F.greatest(F.col("n_est") - (WINDOW - 1), F.lit(0)))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-windows // BUCKET_ENTRIES))
    compressed = rows.select("doc_id", "sha", _zstd("text").alias("z"))
    joined = compressed.join(texts.drop("n_est").hint("merge"), "sha").select(
        "doc_id", "sha", "rank", (place != F.col("first")).alias("copy"),
        F.when(place == F.col("first"), F.col("z")).alias("z"),
    )
    # bucketed by text in the shared folder: rows arrive partitioned by it from the join, so each task writes about one
    # file, and the last pass meets its removals without moving texts again
    name = f"substring_dedup_{uuid.uuid4().hex}"
    joined.write.option("path", scratch_path(spark, "substring-dedup")).bucketBy(partitions, "sha").saveAsTable(name)
    stored = spark.table(name)
    reps = stored.where(~F.col("copy")).select("sha", "rank", "z")
    packed = reps.select("rank", "z").mapInPandas(_packed(buckets), PACKED)
    removed = packed.repartition(buckets, "route").sortWithinPartitions("route", "removed").mapInPandas(_removed, REMOVED)
    found = (
        removed.join(texts.select(F.col("rank").alias("r"), "sha"), "r")
        .groupBy("sha").agg(F.collect_list("s").alias("starts"), F.collect_list("h").alias("hashes"))
    )
    per_text = reps.dropDuplicates(["sha"]).join(found, "sha", "left").select("rank", "z", "starts", "hashes").mapInPandas(
        _per_text, PER_TEXT)
    every = stored.select("doc_id", "rank", "copy").join(per_text, "rank")
    later = F.col("copy") & (F.col("n_words") >= WINDOW)
    return every.select(
        "doc_id", "n_words",
        F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.lit(EMPTY_SHA)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, w[s:s + 19] AS seq FROM d, range(1, len(w) - 18) t(s) WHERE len(w) >= 20
), first_doc AS (
  SELECT seq, min(doc_id) AS fd FROM win GROUP BY seq
), first_place AS (
  SELECT w.seq, f.fd, min(w.s) AS fs FROM win w JOIN first_doc f ON w.seq = f.seq AND w.doc_id = f.fd GROUP BY w.seq, f.fd
), gone AS (
  SELECT DISTINCT w.doc_id, w.s + k AS pos
  FROM win w JOIN first_place f ON w.seq = f.seq, range(0, 20) r(k)
  WHERE w.doc_id > f.fd OR (w.doc_id = f.fd AND w.s > f.fs)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.pos) AS kept
  FROM words x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.pos = g.pos WHERE g.doc_id IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
