"""Exact order statistics and neighbours without a window over an unbounded group.

Rows are range-partitioned into slices and checkpointed, which fixes the slice borders for every later use (and
after the loss of an executor). A window then runs inside one slice of a group, and one small row per slice carries
totals, or the last row, on to the next slice; only those small rows see a window over the whole group. For
order statistics equal values are first collapsed to one row by a partially aggregated ``groupBy``, so ties
never pile up.

``slices`` None takes the session's number of shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ready_for_checkpoint

SLICE = "_slice"


def _sliced(df: DataFrame, order: list, slices: int | None) -> DataFrame:
    spark = df.sparkSession
    ready_for_checkpoint(spark)
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn(SLICE, F.spark_partition_id()).checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, for a small result that several order statistics read."""
    ready_for_checkpoint(df.sparkSession)
    return df.checkpoint()


def running_totals(
    df: DataFrame, group: list[str], value: str, sums: dict[str, Column], slices: int | None = None, descending: bool = False
) -> DataFrame:
    """One row per (group, value) with each sum, its total ``<name>_before`` over smaller values of the group
    (larger if ``descending``) and its group total ``<name>_all``."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    totals = df.groupBy(*group, value).agg(*[c.alias(n) for n, c in sums.items()])
    sliced = _sliced(totals, [*group, order], slices)
    by_slice = W.partitionBy(*group).orderBy(SLICE)
    before = by_slice.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*group)
    offsets = sliced.groupBy(*group, SLICE).agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    offsets = offsets.select(
        *group,
        SLICE,
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_offset") for n in sums],
        *[F.sum(f"_{n}").over(everything).alias(f"{n}_all") for n in sums],
    )
    inside = W.partitionBy(*group, SLICE).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = sliced.join(offsets, [*group, SLICE]) if group else sliced.join(offsets, SLICE)
    return joined.select(
        *group,
        value,
        *sums,
        *[(F.col(f"_{n}_offset") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in sums],
        *[F.col(f"{n}_all") for n in sums],
    )


def ranked_values(df: DataFrame, group: list[str], value: str, slices: int | None = None, descending: bool = False) -> DataFrame:
    """(group, value, rank, avg_rank, n_all) per distinct non-NULL value."""
    t = running_totals(df.where(F.col(value).isNotNull()), group, value, {"n": F.count("*")}, slices, descending)
    return t.select(
        *group,
        value,
        (F.col("n_before") + 1).alias("rank"),
        (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("avg_rank"),
        "n_all",
    )


def percentiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float], slices: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per name in ``probs``; NULL values are ignored."""
    t = running_totals(df.where(F.col(value).isNotNull()), group, value, {"n": F.count("*")}, slices)
    picks = []
    for name, q in probs.items():
        pos = (F.col("n_all") - 1) * F.lit(q)
        lo, hi = F.floor(pos), F.ceil(pos)
        holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        picks += [
            F.max(F.when(holds(lo), F.col(value).cast("double"))).alias(f"_{name}_lo"),
            F.max(F.when(holds(hi), F.col(value).cast("double"))).alias(f"_{name}_hi"),
            F.max(pos - lo).alias(f"_{name}_w"),
        ]
    at = t.groupBy(*group).agg(*picks)
    return at.select(
        *group,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n) for n in probs
        ],
    )


def with_previous(
    df: DataFrame, group: list[str], order: list[str], cols: list[str], into: str, slices: int | None = None
) -> DataFrame:
    """Adds struct ``into`` = ``cols`` of the row before in its group; ``order`` must be unique inside a group."""
    rec = F.struct(*cols)
    sliced = _sliced(df, [*group, *order], slices)
    last = sliced.groupBy(*group, SLICE).agg(F.max_by(rec, F.struct(*order)).alias("_last"))
    carried = last.select(
        *group, SLICE, F.lag("_last").over(W.partitionBy(*group).orderBy(SLICE)).alias("_carried")
    )
    inner = sliced.withColumn("_prev", F.lag(rec).over(W.partitionBy(*group, SLICE).orderBy(*order)))
    return (
        inner.join(carried, [*group, SLICE])
        .withColumn(into, F.coalesce("_prev", "_carried"))
        .drop("_prev", "_carried", SLICE)
    )
