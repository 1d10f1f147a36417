"""Usage at (account, day) grain.

Whether a log is valid depends only on its account and day, so everything except the row-level tables
works on this roll-up. Its partial aggregation runs before any shuffle and leaves at most one row per
account and calendar day, whatever the number of logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import in_months

VALID = "valid"
BAD_ACCOUNT = "orphan_bad_account"
OUT_OF_WINDOW = "orphan_out_of_window"


def daily_rollup(logs: DataFrame) -> DataFrame:
    """(account_id, usage_date, n_logs, credits_consumed) of the staged logs."""
    return logs.groupBy("account_id", "usage_date").agg(
        F.count("*").alias("n_logs"),
        F.sum("credits_consumed").alias("credits_consumed"),
    )


def contract_spans(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy("account_id").agg(
        F.min("start_date").alias("earliest_start"), F.max("end_date").alias("latest_end")
    )


def account_spans(accounts: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row per known account with the span of its contracts (NULL without any)."""
    return (
        accounts.select("account_id")
        .join(contract_spans(contracts), "account_id", "left")
        .withColumn("known", F.lit(True))
    )


def usage_class() -> F.Column:
    """Class of a usage row that carries the columns of ``account_spans``."""
    inside = F.col("usage_date").between(F.col("earliest_start"), F.col("latest_end"))
    return (
        F.when(F.col("known").isNull(), BAD_ACCOUNT)
        .when(F.coalesce(inside, F.lit(False)), VALID)
        .otherwise(OUT_OF_WINDOW)
    )


def classify_daily(daily: DataFrame, spans: DataFrame) -> DataFrame:
    return daily.join(spans, "account_id", "left").select(*daily.columns, usage_class().alias("usage_class"))


def daily_of_classified(logs: DataFrame) -> DataFrame:
    """The rows of ``classify_daily`` from logs that carry their class, which their account and day decide: no second look at the spans."""
    return logs.groupBy("account_id", "usage_date", "usage_class").agg(
        F.count("*").alias("n_logs"),
        F.sum("credits_consumed").alias("credits_consumed"),
    ).select("account_id", "usage_date", "n_logs", "credits_consumed", "usage_class")


def valid_only(daily: DataFrame, spans: DataFrame) -> DataFrame:
    """The valid rows of ``classify_daily``, as an inner join that drops the rest before it is widened."""
    inside = spans.where(F.col("earliest_start").isNotNull())
    return (
        daily.join(inside, "account_id")
        .where(F.col("usage_date").between(F.col("earliest_start"), F.col("latest_end")))
        .select(*daily.columns)
    )


def window_totals(valid_daily: DataFrame, p) -> DataFrame:
    """Trailing-window and first-month credits per account, from valid daily usage."""
    in_m1 = F.col("usage_date") <= F.lit(p.m1_end)
    credits = F.col("credits_consumed")
    return (
        in_months(valid_daily, p.window_start, p.as_of)
        .where((F.col("usage_date") > F.lit(p.window_start)) & (F.col("usage_date") <= F.lit(p.as_of)))
        .groupBy("account_id")
        .agg(
            F.sum(credits).alias("credits_90d"),
            F.sum(F.when(in_m1, credits)).alias("credits_month_1"),
        )
    )


def reconcile(logs: DataFrame) -> DataFrame:
    """One row per (account, day): replayed log ids counted once, then summed.

    Of several versions of a log id the one with the latest day, then the most credits, is kept. Ids hardly repeat, so the
    logs are shuffled by id as they are and sorted once after it; the daily sums aggregate before their shuffle.
    """
    version = F.struct("usage_date", "credits_consumed", "account_id")
    once = logs.repartition(F.col("log_id")).groupBy("log_id").agg(F.max(version).alias("v")).select("v.*")
    return daily_rollup(once)
