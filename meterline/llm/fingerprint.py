"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

All shingles of five words are hashed once. The leading bits of a hash name its bin, and each bin keeps its smallest
hash. An empty bin takes the value of another, found by a fixed sequence of probes of its own, so that equal sets fill
alike and similar sets mostly so. The four low-order bits of each bin are packed into longs; two fingerprints
agree in a share P of their bins, of which 1/16 is chance, hence likeness = (P - 1/16) / (1 - 1/16), at least 0.

Everything is built-in DataFrame expressions. To get one value per bin from a sorted array, the largest value of every
bin is added before the sort; the first of each bin is then its minimum or that marker.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BINS = 256
BIN_BITS = 8
LOW_BITS = 4
SHINGLE = 5
PROBES = 12
SEED = 20240
BUCKET_ROWS = 500
BOUND_ROWS = 2_000_000
BUCKET_BITS = (4, 16)


def words_of(text: Column) -> Column:
    """Runs of other than space and \\t-\\r; none for null, empty or blank texts."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of ``k`` words; of the whole sequence if there are fewer; none without words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # let-binding: a one-element array, so that the word hashes are computed once per document
    runs = F.transform(
        F.array(hashed),
        lambda h: F.when(
            F.size(h) >= k,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
            ),
        ).otherwise(F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))),
    )
    return F.element_at(runs, 1)


def bins_of(shingles: Column) -> Column:
    """The smallest hash of each of the bins in order; null where a bin is empty."""
    width = 1 << (64 - BIN_BITS)
    low = -(1 << 63)
    ends = F.array(*[F.lit(low + (i + 1) * width - 1) for i in range(BINS)])
    ordered = F.array_sort(F.concat(shingles, ends))
    firsts = F.transform(
        F.array(ordered),
        lambda a: F.filter(
            a,
            lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(a, i - 1), 64 - BIN_BITS)),
        ),
    )
    return F.transform(
        F.element_at(firsts, 1), lambda x: F.when((x.bitwiseAND(F.lit(width - 1))) != width - 1, x)
    )


def _probes() -> list[list[int]]:
    """For each round, the bin that each bin looks at."""
    rng = random.Random(SEED)
    orders = [rng.sample([b for b in range(BINS) if b != i], PROBES) for i in range(BINS)]
    return [[orders[i][r] for i in range(BINS)] for r in range(PROBES)]


def densified(bins: Column) -> Column:
    """Fills empty bins: the first filled bin in the bin's own probe order, after the listed probes the one that a
    hash of both bins puts first. Null if all are empty."""
    rounds = [F.array(*map(F.lit, r)) for r in _probes()]

    def rest(a: Column, i: Column) -> Column:
        ranked = F.transform(a, lambda x, j: F.when(x.isNotNull(), F.struct(F.xxhash64(i, j).alias("r"), x.alias("x"))))
        return F.array_min(ranked).getField("x")

    return F.element_at(
        F.transform(
            F.array(bins),
            lambda a: F.transform(a, lambda x, i: F.coalesce(x, *[F.get(a, F.get(r, i)) for r in rounds], rest(a, i))),
        ),
        1,
    )


def packed(text: Column) -> Column:
    """Sixteen longs of low-order bits; an empty array for a text without words."""
    per_long = 64 // LOW_BITS
    mask = (1 << LOW_BITS) - 1
    dense = densified(bins_of(shingles_of(words_of(text))))
    folded = F.transform(
        F.array(dense),
        lambda d: F.transform(
            F.sequence(F.lit(0), F.lit(BINS // per_long - 1)),
            lambda g: F.aggregate(
                F.slice(d, g * per_long + 1, F.lit(per_long)),
                F.lit(0).cast("long"),
                lambda acc, v: F.shiftleft(acc, LOW_BITS).bitwiseOR(F.coalesce(v, F.lit(0).cast("long")).bitwiseAND(F.lit(mask))),
            ),
        ),
    )
    has_words = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return F.when(has_words, F.element_at(folded, 1)).otherwise(F.array().cast("array<bigint>"))


def shown(code: Column) -> Column:
    return F.array_join(F.transform(code, lambda v: F.lpad(F.lower(F.hex(v)), 64 // LOW_BITS, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, corrected for low-order bits that agree by chance; 1 for two texts without words."""
    ones = int("1" * (64 // LOW_BITS), 16)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(ones)))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, v: acc + v)
    chance = 1.0 / (1 << LOW_BITS)
    agree = F.lit(1.0) - off.cast("double") / F.lit(float(BINS))
    corrected = F.greatest((agree - F.lit(chance)) / F.lit(1.0 - chance), F.lit(0.0))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(corrected)
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row. Null, empty and blank texts have the empty string; equal texts, and texts
    equal but for white space and A-Z case, have equal fingerprints. Other columns are ignored."""
    return docs.select("doc_id", shown(packed(F.col("text"))).alias("fingerprint"))


def bucket_of(column: str, bounds: list) -> Column:
    """How many of the sorted ``bounds`` (2**m - 1 of them) are at most the value: a search of m steps."""
    values = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded into one constant
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - 1) <= F.col(column), at + step).otherwise(at)
    )


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """``docs(doc_id, text)`` with ``derived`` columns, and ``next_text`` and ``next_*`` of the next row by doc_id; after the last comes the first.

    Rows are dealt into ranges of ids at estimated quantiles, about ``BUCKET_ROWS`` rows each (65,536 ranges at most); a window
    looks ahead inside a range, and only the first row of each range meets the last of the one before. Rows with equal ids
    are ordered by their text.
    """
    low, high = BUCKET_BITS
    count = docs.count()
    wide = 1 << min(max((count // BUCKET_ROWS).bit_length(), low), high)
    # the bounds only make the ranges even, so of a large table some ids are enough to place them
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, count // BOUND_ROWS))) == 0)
    bounds = some.approxQuantile("doc_id", [i / wide for i in range(1, wide)], 0.25 / wide)
    bucket = bucket_of("doc_id", [int(b) for b in bounds]) if bounds else F.lit(0)
    dealt = docs.withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))
    columns = ["text", *derived]
    order = Window.partitionBy("_bucket").orderBy("doc_id", "text")
    rows = dealt.withColumns(derived).withColumn("_n", F.lead(F.struct(*columns)).over(order))
    # the first row of each range: at most one id per range, so the ids are small; only these texts are read again
    ids = dealt.groupBy("_bucket").agg(F.min("doc_id").alias("_id")).select(F.col("_bucket").alias("_b"), "_id")
    first = dealt.join(F.broadcast(ids), (F.col("_bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    heads = first.groupBy("_b").agg(F.min("text").alias("text")).withColumns(derived).select("_b", F.struct(*columns).alias("_h"))
    ring = Window.orderBy("_b")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_b", F.coalesce(F.lead("_h").over(ring), F.first("_h").over(whole)).alias("_h"))
    inner = rows.filter(F.col("_n").isNotNull())
    last = rows.filter(F.col("_n").isNull()).join(heads, F.col("_bucket") == F.col("_b"))
    kept = ["doc_id", *columns]
    return inner.select(*kept, *[F.col(f"_n.{c}").alias(f"next_{c}") for c in columns]).unionByName(
        last.select(*kept, *[F.col(f"_h.{c}").alias(f"next_{c}") for c in columns])
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited forms. A null text counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return edited(docs)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and edited texts of ``docs(doc_id, text)`` without null texts; an empty table gives no rows,
    a single document is its own next."""
    pairs = with_next(docs, {"code": packed(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / F.lit(4)).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    out = pairs.select("doc_id", "code", "next_code", n.cast("long").alias("n_chars"), text.alias("edited"))
    out = out.withColumn("edited_code", packed(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        shown(F.col("code")).alias("fingerprint"),
        shown(F.col("edited_code")).alias("edited_fingerprint"),
        likeness(F.col("code"), F.col("edited_code")).alias("near_edited"),
        likeness(F.col("code"), F.col("next_code")).alias("near_next"),
    )
