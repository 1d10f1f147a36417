"""Reports that go through a written table: source and sink round trips, frozen months, corrections, the stream."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready_for_checkpoint, scratch_path
from ..sources import readers, schemas, sinks
from ..streaming import rollup as R
from . import history, models
from .marts import desc


def src_csv_roundtrip(b) -> DataFrame:
    """Contracts written as CSV and loaded with the declared schema."""
    path = scratch_path(b.spark, "csv")
    sinks.write_csv(b.sources["contracts"], path)
    return readers.read_csv(b.spark, path, schemas.CONTRACTS)


def src_parquet_roundtrip(b) -> DataFrame:
    """All tables of a snapshot written and read back, as row counts."""
    from .build import write_all

    path = scratch_path(b.spark, "tables")
    stored = write_all(b.spark, b.sources, path, b.p)
    counts = [
        getattr(stored, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows")) for t in models.TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def src_labels(b) -> DataFrame:
    """Labels written as CSV only, so the reader falls back to it."""
    path = scratch_path(b.spark, "labels")
    sinks.write_csv(b.rule_archetype, f"{path}/csv")
    return readers.read_labels(b.spark, f"{path}/parquet", f"{path}/csv")


def src_incremental_merge(b) -> DataFrame:
    """A month-partitioned usage table that first holds doubled credits for recent logs and lacks the newest ones;
    an incoming batch replaces the touched months. Returns the table per month."""
    spark, t = b.spark, b.p.as_of
    ready_for_checkpoint(spark)
    path = scratch_path(spark, "usage")
    logs = b.stg_daily_usage_logs
    recent = F.col("usage_date") > F.lit(t - timedelta(days=60))
    stale = logs.where(F.col("usage_date") <= F.lit(t)).withColumn(
        "credits_consumed",
        F.when(recent, F.col("credits_consumed") * 2).otherwise(F.col("credits_consumed")).cast("decimal(18,2)"),
    )
    sinks.write_usage(stale, path)
    sinks.merge_usage(spark, path, logs.where(recent))
    return (
        spark.read.parquet(path)
        .groupBy("usage_month")
        .agg(F.count("*").alias("n_logs"), F.sum("credits_consumed").alias("credits"))
    )


def retention_expire(b) -> DataFrame:
    """The staged logs written by month, then expired: months wholly before the retention period are aggregated per
    account into an archive and their detail deleted. Returns what is left, per account: days of the kept months, and
    the archived months (grain ``month``). The sums equal those of the logs before expiry."""
    from ..sources.retention import archived, expire_months

    spark, p = b.spark, b.p
    ready_for_checkpoint(spark)
    path = scratch_path(spark, "retained")
    sinks.write_usage(b.stg_daily_usage_logs, path)
    cutoff = p.retention_from.replace(day=1)
    expire_months(spark, path, f"{path}_archive", "usage_month", cutoff, ["account_id"],
                  [F.sum("credits_consumed").alias("credits")])
    days = (
        spark.read.parquet(path).groupBy("account_id", F.lit("day").alias("grain"), F.col("usage_date").alias("period_start"))
        .agg(F.count("*").alias("n_logs"), F.sum("credits_consumed").alias("credits"))
    )
    months = archived(spark, f"{path}_archive").select(
        "account_id", F.lit("month").alias("grain"), F.col("usage_month").alias("period_start"),
        F.col("n_detail_rows").alias("n_logs"), "credits",
    )
    return days.unionByName(months)


def eval_report_delta_stored(b) -> DataFrame:
    """Three evaluation runs stored as a build stores them (a week before the prior as-of date, the prior as-of date and
    the as-of date), then the report of the two latest read back from the stored table. All three read one written roll-up."""
    from datetime import datetime, time

    from . import evals

    spark, p = b.spark, b.p
    folder = scratch_path(spark, "runs")
    for run_id, day in (("r1", p.prior_as_of - timedelta(days=7)), ("r2", p.prior_as_of), ("r3", p.as_of)):
        book = b if day == p.as_of else b.at(day)
        results = evals.eval_results(book).withColumn("test_id", F.col("check_id")).withColumn(
            "status", F.when(F.col("passed"), "pass").otherwise("fail"))
        sinks.put_run(results, f"{folder}/eval_results", schemas.EVAL_RESULTS,
                      {"run_id": F.lit(run_id), "run_ts": F.lit(datetime.combine(day, time()))})
    delta = evals.stored_report_delta(spark, folder)
    return delta.drop("prev_run_id", "curr_run_id")


def export_csv(b) -> DataFrame:
    """All accounts of the current mart as CSV, largest first, read back."""
    path = scratch_path(b.spark, "export")
    cols = ["account_id", "rep_id", "committed_arr", "healthscore", "carr", "band"]
    sinks.export_csv(b.mart_carr_current.select(*cols), path, [*desc("carr"), F.col("account_id")])
    schema = "account_id string, rep_id string, committed_arr decimal(28,2), healthscore double, carr double, band string"
    return b.spark.read.schema(schema).option("header", True).csv(path)


def _published(b) -> tuple[str, DataFrame]:
    """The folder of all month-ends, published once, and what was to be published."""
    path, rows = scratch_path(b.spark, "frozen"), history.carr_account_month_end(b)
    sinks.publish_months(rows, path)
    return path, rows


def freeze_write(b) -> DataFrame:
    """Published months with their totals after a second write was tried."""
    path, rows = _published(b.rolled)
    again = sinks.publish_months(rows.withColumn("carr", F.lit(0.0)), path)
    refused = b.spark.createDataFrame([(m,) for m in again], "month_end date").withColumn("refused", F.lit(True))
    kept = b.spark.read.parquet(path).groupBy("month_end").agg(
        F.count("*").alias("n_accounts"), F.sum(F.col("carr").cast("decimal(28,6)")).alias("carr")
    )
    return kept.join(refused, "month_end", "left").select(
        "month_end", "n_accounts", "carr", F.coalesce("refused", F.lit(False)).alias("second_write_refused")
    )


def freeze_digest_check(b) -> DataFrame:
    """Month-ends published once with their digests; then the month-ends again, from the raw logs in another physical
    order, compared month by month with the stored digests alone."""
    from .book import Book

    path, _ = _published(b)
    logs = b.sources["daily_usage_logs"]
    shuffled = dict(b.sources, daily_usage_logs=logs.repartition(F.xxhash64("date", "compute_credits_consumed", "account_id")))
    again = history.carr_account_month_end(Book(shuffled, b.p))
    return sinks.changed_months(again, path).select(
        "month_end", F.col("n_rows").alias("n_accounts"), F.col("matches").alias("digest_matches"))


def _backfilled(b):
    """The metric once every log of a known account counts, as after a backfill of contracts."""
    from .book import Book

    again = Book(b.sources, b.p)
    again.valid_daily = b.rolled.usage_rollup.join(b.sources["accounts"].select("account_id"), "account_id", "left_semi")
    return again


def restatement_diff(b) -> DataFrame:
    """Accounts of published months that a backfill would move, appended to the table of restatements and read back.

    Differences above 500 dollars need a restatement, smaller ones a note.
    """
    path, _ = _published(b.rolled)
    diff = history.restatement_diff(b.spark.read.parquet(path), history.carr_account_month_end(_backfilled(b)), 500.0)
    table = scratch_path(b.spark, "restatements")
    sinks.append_results(diff, table, schemas.RESTATEMENTS, {"rationale": F.lit("usage backfill")})
    return b.spark.read.parquet(table).drop("approvers", "changelog_link")


def restatement_by_rep(b) -> DataFrame:
    """Reps of published months that the same backfill would move; above 5,000 dollars they need a restatement."""
    path, _ = _published(b.rolled)
    old, new = b.spark.read.parquet(path), history.carr_account_month_end(_backfilled(b))
    return history.restatement_diff(history.carr_per_rep(old), history.carr_per_rep(new), 5000.0, "rep_id")


def stream_daily_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream whose micro-batches upsert a daily table; the table as it stands after the stream."""
    from ..streaming import incremental

    base = scratch_path(spark, "stream-daily")
    usage = R.usage_events(R.read_events(spark, folder, "events.parquet"))
    incremental.start(usage, f"{base}/tables", f"{base}/state").awaitTermination()
    return incremental.read_daily(spark, f"{base}/tables")


def stream_daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream, landed by day and reconciled to daily usage: open days and late events included."""
    base = scratch_path(spark, "stream")
    R.land(R.usage_events(R.read_events(spark, folder, "events.parquet")), f"{base}/events", f"{base}/state").awaitTermination()
    return R.reconciled(R.landed(spark, f"{base}/events"))
