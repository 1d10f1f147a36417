"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Every document gets the key -ln(u) / weight, where u is a fixed hash of its id and weight its quality; ascending keys are
a weighted random order. A source with a target of two and a bit times its size is taken twice as a whole and a bit
in that order, up to its word budget.

There is no sort of a whole source. Keys are cut into ranges twice: summed sizes per range show in which range the budget
ends, and only rows of that range are looked at again. The last range is sorted, so that a source with a third of all
rows costs two aggregations and a window over a millionth of it. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.session import ready_for_checkpoint, scratch_path

from .common import table

#: fixed value: a word, as the query's contract defines it
WORD = r"[^\x20\x09-\x0D]+"
SHARES = (5, 2, 1)
VOLUME = 1.5
MOST_EPOCHS = 2
RANGES = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: the share of letters, digits and spaces among the characters, to the fourth power."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))
    share = plain.cast("double") / F.greatest(F.length(text), F.lit(1))
    squared = share * share
    return F.coalesce(F.greatest(F.lit(0.05), squared * squared), F.lit(0.05))


def uniform(key: Column) -> Column:
    """A fixed number above 0 and below 1 from the key's digest."""
    head = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")
    return (head.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, shares=SHARES, volume: float = VOLUME, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources in code-point order, null last, weigh ``shares`` in turn. Water level: sources in ascending order of cap over
    weight reach their cap one after the other; the first that doesn't sets the level for itself and all after it (at later ones the formula gives lower values still).
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    filling = Window.orderBy("_ratio", "_nth")
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, shares)), (F.col("_nth") % len(shares) + 1).cast("int"))
    before = F.sum("_cap").over(filling) - F.col("_cap")
    left = F.sum("_w").over(everything) - F.sum("_w").over(filling) + F.col("_w")
    level = (F.sum("source_size").over(everything) * F.lit(volume) - before) / left
    return (
        sizes.withColumn("_nth", F.row_number().over(ordered) - 1)
        .withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", level)
        .withColumn("_stop", F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(everything))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_stop") * F.col("_w"), F.col("_cap"))))
        .select("source", "source_size", "target")
    )


def plan_mix(
    docs: DataFrame, weight: Column | None = None, shares=SHARES, volume: float = VOLUME, most: int = MOST_EPOCHS
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies`` of every row of ``docs(doc_id, text, source)``.

    Complete epochs first: every document ``floor(target / source_size)`` times. Then, in key order, whole documents while
    at least half of each fits into what is left of the budget. Null or empty texts have size 0, a null source is a source of its own,
    sorted last. Equal keys (repeated rows) are ordered by id and size, and rows that agree in both are alike.
    A table without words has targets of 0 and takes nothing; an empty one gives no rows. Other columns are ignored.
    """
    ready_for_checkpoint(docs.sparkSession)
    return planned(keyed(docs, weight).checkpoint(), (), shares, volume, most)


def keyed(docs: DataFrame, weight: Column | None, *more: Column) -> DataFrame:
    """``doc_id, source, size``, the key and its ranges of every row, and ``more``."""
    text = F.col("text")
    key = -F.log(uniform(F.col("doc_id"))) / (quality_weight(text) if weight is None else weight)
    # exp(-key) is uniform for weight 1 and keeps the order for all weights, so its leading digits make even ranges
    place = (F.lit(1.0) - F.exp(-F.col("_key"))) * RANGES
    return (
        docs.select("doc_id", "source", size_of(text).alias("size"), key.alias("_key"), *more)
        .withColumn("_a", F.least(F.floor(place), F.lit(RANGES - 1)).cast("int"))
        .withColumn("_b", F.least(F.floor((place - F.col("_a")) * RANGES), F.lit(RANGES - 1)).cast("int"))
    )


def planned(
    rows: DataFrame, more: tuple[str, ...] = (), shares=SHARES, volume: float = VOLUME, most: int = MOST_EPOCHS
) -> DataFrame:
    """The plan of rows that ``keyed`` has made and that are stored, with the columns ``more``, the last of which orders rows that agree otherwise."""
    per_range = rows.groupBy("source", "_a").agg(F.sum("size").alias("_sum"))
    sizes = per_range.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = (
        targets(sizes, shares, volume, most)
        .withColumn("_epochs", epochs.cast("long"))
        .withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .checkpoint()
    )

    def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
        on = left["source"].eqNullSafe(right["_source"])
        for n in names:
            on = on & (left[n] == right[f"_{n}_at"])
        return on

    def ending(sums: DataFrame, level: str, start: DataFrame, *names: str) -> DataFrame:
        """The range in which each source's budget ends, and the words before it."""
        over = Window.partitionBy("source").orderBy(level)
        reached = sums.join(start, same(sums, start, *names)).withColumn("_until", F.sum("_sum").over(over) + F.col("_base"))
        return (
            reached.filter(F.col("_until") > F.col("_budget"))
            .groupBy("source")
            .agg(F.min_by(F.struct(F.col(level), F.col("_until") - F.col("_sum")), level).alias("_e"))
            .select(F.col("source").alias("_source"), F.col(f"_e.{level}").alias(f"_{level}_at"), F.col("_e.col2").alias("_base"))
        )

    budgets = goal.select(F.col("source").alias("_source"), "_budget", F.lit(0).cast("long").alias("_base"))
    first = ending(per_range, "_a", budgets)
    first = first.join(goal.select(F.col("source").alias("_s"), "_budget"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    first = first.checkpoint()  # a row per source; the rows below then meet a table of known size
    inner = rows.join(first, same(rows, first, "_a")).drop("_source", "_base", "_budget", "__a_at")
    per_inner = inner.groupBy("source", "_a", "_b").agg(F.sum("size").alias("_sum"))
    second = ending(per_inner, "_b", first, "_a")
    marks = (
        goal.join(first.select(F.col("_source").alias("_s1"), F.col("__a_at").alias("_a_end")), F.col("source").eqNullSafe(F.col("_s1")), "left")
        .join(
            second.select(F.col("_source").alias("_s2"), F.col("__b_at").alias("_b_end"), F.col("_base").alias("_before")),
            F.col("source").eqNullSafe(F.col("_s2")),
            "left",
        )
        .select(F.col("source").alias("_source"), "source_size", "target", "_epochs", "_budget", "_a_end", "_b_end", "_before")
        .checkpoint()
    )
    joined = rows.join(marks, rows["source"].eqNullSafe(marks["_source"]))
    at_end = (F.col("_a") == F.col("_a_end")) & (F.col("_b") == F.col("_b_end"))
    earlier = (F.col("_a") < F.col("_a_end")) | ((F.col("_a") == F.col("_a_end")) & (F.col("_b") < F.col("_b_end")))
    some = F.col("_budget") > 0
    kept = ["doc_id", "source", "size", "source_size", "target", *more]
    clear = joined.filter(~F.coalesce(at_end, F.lit(False))).select(
        *kept, (F.col("_epochs") + F.coalesce(earlier & some, F.lit(False)).cast("long")).alias("copies")
    )
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size", *more[-1:])
    until = F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = until - F.col("size") / F.lit(2.0) <= F.col("_budget")
    ends = (F.col("_a") == F.col("_a_end")) & (F.col("_b") == F.col("_b_end"))
    boundary = rows.join(marks, rows["source"].eqNullSafe(marks["_source"]) & ends)
    last = boundary.withColumn("_in", fits & some).select(*kept, (F.col("_epochs") + F.col("_in").cast("long")).alias("copies"))
    everything = clear.unionByName(last).withColumn("taken", F.col("size") * F.col("copies"))
    return everything.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", *more)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, each as often as it is taken."""
    return mix(docs)


def mix(docs: DataFrame, weight: Column | None = None, **settings) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with their own columns.

    Each row is taken for itself, also one of a repeated or null id. The rows are written once with what the plan needs, so that
    they go through it and nothing has to be joined by id; the plan's sums read its own columns only. At the end of a budget,
    rows that agree in key, id and size follow a digest of all their columns.
    """
    spark = docs.sparkSession
    ready_for_checkpoint(spark)
    whole = F.struct(*[docs[n] for n in docs.columns])
    keyed(docs, weight, whole.alias("_doc"), F.xxhash64(whole).alias("_digest")).write.parquet(path := scratch_path(spark, "mix"))
    plan = planned(spark.read.parquet(path), ("_doc", "_digest"), **settings).filter("copies > 0")
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u,
         length(regexp_replace(text, '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'))::DOUBLE / greatest(length(text), 1) AS share
  FROM documents
), k AS (
  SELECT doc_id, source, size, -ln(u) / coalesce(greatest(0.05, (share * share) * (share * share)), 0.05) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), w AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w,
         row_number() OVER (ORDER BY source IS NULL, source) AS nth
  FROM s
), r AS (SELECT *, source_size * 2 AS cap, (source_size * 2) / w AS ratio FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - ((sum(cap) OVER (ORDER BY ratio, nth)) - cap)::DOUBLE)
            / ((sum(w) OVER ()) - (sum(w) OVER (ORDER BY ratio, nth)) + w)::DOUBLE AS level
  FROM r
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN level < ratio THEN level END) OVER () * w, cap)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), c AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size / 2.0 AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + (middle <= budget)::INT))::BIGINT AS taken FROM c
"""
