"""Contracts as closed day intervals.

Contracts are first reduced to one row per (account, day of the calendar): daily deltas, or the latest end
per start day. Windows per account then run over at most one row per calendar day, however many contracts
an account has.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daynum(d: Column | str) -> Column:
    return F.datediff(F.col(d) if isinstance(d, str) else d, F.lit(date(1970, 1, 1)))


def daily_deltas(contracts: DataFrame) -> DataFrame:
    """(account_id, day, d_n, d_arr_cents, d_included): what changes on that day. An end takes effect the day after.

    Money is summed in whole cents, which stays exact and inside code generation.
    """
    steps = F.array(
        F.struct(F.col("start_date").alias("day"), F.lit(1).alias("sign")),
        F.struct(F.date_add("end_date", 1).alias("day"), F.lit(-1).alias("sign")),
    )
    s = F.col("step.sign")
    return (
        contracts.where(F.col("end_date") >= F.col("start_date"))
        .select("account_id", "annual_commit_dollars", "included_monthly_credits", F.explode(steps).alias("step"))
        .groupBy("account_id", F.col("step.day").alias("day"))
        .agg(
            F.sum(s.cast("bigint")).alias("d_n"),
            F.sum((F.col("annual_commit_dollars") * 100).cast("bigint") * s).alias("d_arr_cents"),
            F.sum(F.col("included_monthly_credits") * s).alias("d_included"),
        )
    )


def as_day(d: Column | date) -> Column:
    return d if isinstance(d, Column) else F.lit(d)


def in_months(df: DataFrame, low: Column | date, high: Column | date, month: str = "usage_month") -> DataFrame:
    """Adds the month range of a day range where the table is partitioned by month, so that other folders aren't opened."""
    if month not in df.columns:
        return df
    return df.where(F.col(month).between(F.trunc(as_day(low), "month"), F.trunc(as_day(high), "month")))


def clip(contracts: DataFrame, low: Column | date, high: Column | date) -> DataFrame:
    """Contracts that touch [low, high], cut to it."""
    low, high = as_day(low), as_day(high)
    return (
        contracts.where((F.col("end_date") >= low) & (F.col("start_date") <= high))
        .where(F.col("end_date") >= F.col("start_date"))
        .withColumn("start_date", F.greatest("start_date", low))
        .withColumn("end_date", F.least("end_date", high))
    )


def contract_days(contracts: DataFrame, low: Column | date, high: Column | date) -> DataFrame:
    """One row per contract and day it is active on within [low, high]."""
    return clip(contracts, low, high).select(
        "contract_id",
        "account_id",
        F.explode(F.sequence("start_date", "end_date")).alias("day"),
        "annual_commit_dollars",
        "included_monthly_credits",
    )


def primary_contract_days(contracts: DataFrame, low: Column | date, high: Column | date) -> DataFrame:
    """Per account and day the active contract with the most included credits; ties go to the smallest id.

    The winner changes only where a contract starts or has ended. Contracts compete per stretch between such days, and
    only the winners are unfolded to days. An account has at most two change points per calendar day.
    """
    # Contracts with the same dates compete everywhere alike, so they are settled first.
    settled = (
        clip(contracts, low, high)
        .groupBy("account_id", "start_date", "end_date", "included_monthly_credits")
        .agg(F.min("contract_id").alias("contract_id"))
    )
    changes = settled.select(
        "account_id", F.explode(F.array(F.col("start_date"), F.date_add("end_date", 1))).alias("day")
    )
    points = changes.groupBy("account_id").agg(F.array_sort(F.collect_set("day")).alias("p"))
    stretches = points.select(
        "account_id",
        F.transform("p", lambda d, i: F.struct(d.alias("since"), F.get(F.col("p"), i + 1).alias("until"))).alias("p"),
    )
    held = lambda s: (s["since"] >= F.col("start_date")) & (s["since"] <= F.col("end_date"))
    pieces = settled.join(stretches, "account_id").select(
        "account_id", "contract_id", "included_monthly_credits", F.inline(F.filter("p", held))
    )
    # Smallest id among equals: aggregate credits first, then the id.
    key = ["account_id", "since", "until"]
    top = pieces.groupBy(*key, "included_monthly_credits").agg(F.min("contract_id").alias("contract_id"))
    winners = top.groupBy(*key).agg(
        F.max_by("contract_id", "included_monthly_credits").alias("contract_id"),
        F.max("included_monthly_credits").alias("included_monthly_credits"),
    )
    return winners.select(
        "account_id",
        F.explode(F.sequence("since", F.date_sub("until", 1))).alias("day"),
        "contract_id",
        "included_monthly_credits",
    )


def active_stretches(contracts: DataFrame) -> DataFrame:
    """Disjoint stretches (account_id, oldest_active_start, from_day, to_day) that together cover every active day.

    Within a stretch the oldest active contract starts on ``oldest_active_start``. A start day s owns the days
    after all older contracts have ended, up to the latest end of the contracts starting on s.
    """
    by_start = (
        contracts.where(F.col("end_date") >= F.col("start_date"))
        .groupBy("account_id", "start_date")
        .agg(F.max("end_date").alias("last_end"))
    )
    earlier = W.partitionBy("account_id").orderBy("start_date").rowsBetween(W.unboundedPreceding, -1)
    return (
        by_start.withColumn("older_end", F.max("last_end").over(earlier))
        .select(
            "account_id",
            F.col("start_date").alias("oldest_active_start"),
            F.greatest(F.col("start_date"), F.date_add("older_end", 1)).alias("from_day"),
            F.col("last_end").alias("to_day"),
        )
        .where(F.col("from_day") <= F.col("to_day"))
    )


def totals_by_dates(contracts: DataFrame) -> DataFrame:
    """(account_id, start_date, end_date, n, arr_cents, included): contracts of the same dates added up, money in whole cents."""
    return (
        contracts.where(F.col("end_date") >= F.col("start_date"))
        .groupBy("account_id", "start_date", "end_date")
        .agg(
            F.count("*").alias("n"),
            F.sum((F.col("annual_commit_dollars") * 100).cast("bigint")).alias("arr_cents"),
            F.sum("included_monthly_credits").alias("included"),
        )
    )


def with_stretch(totals: DataFrame) -> DataFrame:
    """Adds ``from_day`` to rows unique in (account_id, start_date, end_date): the first day of the stretch that ``active_stretches``
    has for this start day. It ends with the row; rows that own no stretch have NULL."""
    line = W.partitionBy("account_id").orderBy("start_date", F.desc("end_date"))
    older_end = F.max("end_date").over(line.rowsBetween(W.unboundedPreceding, -1))
    first = ~F.lag("start_date").over(line).eqNullSafe(F.col("start_date"))
    found = totals.select("*", first.alias("_first"), F.greatest("start_date", F.date_add(older_end, 1)).alias("_from"))
    owned = F.col("_first") & (F.col("_from") <= F.col("end_date"))
    return found.withColumn("from_day", F.when(owned, F.col("_from"))).drop("_first", "_from")


def max_concurrency(contracts: DataFrame, low: date, high: date) -> DataFrame:
    """(account_id, max_active): the most contracts active on one day of [low, high]."""
    deltas = daily_deltas(clip(contracts, low, high))
    run = W.partitionBy("account_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return (
        deltas.withColumn("n_active", F.sum("d_n").over(run))
        .groupBy("account_id")
        .agg(F.max("n_active").alias("max_active"))
    )


def overlap_counts(contracts: DataFrame) -> DataFrame:
    """(account_id, n_overlapping_pairs): consecutive contracts where the earlier ends after the later starts.

    Pairs within one start day are counted from aggregates of that day, pairs across days from its last contract.
    """
    by_start = contracts.groupBy("account_id", "start_date").agg(
        F.count_if(F.col("end_date") > F.col("start_date")).alias("ends_later"),
        F.max_by("end_date", "contract_id").alias("last_end"),
    )
    nxt = F.lead("start_date").over(W.partitionBy("account_id").orderBy("start_date"))
    inside = F.col("ends_later") - (F.col("last_end") > F.col("start_date")).cast("bigint")
    across = F.coalesce((F.col("last_end") > F.col("_next")).cast("bigint"), F.lit(0))
    return (
        by_start.withColumn("_next", nxt)
        .groupBy("account_id")
        .agg(F.sum(inside + across).alias("n_overlapping_pairs"))
    )
