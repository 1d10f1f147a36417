"""Writers: full refresh, partitioned usage, incremental replacement, frozen months, append-only results, CSV export."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Of the tables of a snapshot; their ids and keys take about a third less room than in the default codec.
CODEC = "zstd"


def write_table(df: DataFrame, path: str) -> None:
    """Replace the whole table; running it twice gives the same table."""
    df.write.mode("overwrite").option("compression", CODEC).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A written table. Month-partitioned ones keep their month column, so that a filter on it prunes folders."""
    return spark.read.parquet(path)


def by_month(df: DataFrame, day: str, month: str = "usage_month") -> DataFrame:
    """Rows brought together by month. Adaptive execution cuts large months into pieces of its advisory size and joins small
    ones, so neither a large month nor a large account ends up in a single task."""
    return df.withColumn(month, F.trunc(day, "month")).hint("rebalance", F.col(month))


#: Sidecar of a usage table: (64-bit hash of log_id, month) by month. Its name starts with "_", so readers of the table skip it.
LOG_INDEX = "_log_index"


def write_usage(df: DataFrame, path: str, day: str = "usage_date") -> None:
    """Month partitions, sorted by account inside each file so row-group statistics can skip accounts.

    A table with a ``log_id`` also gets its id index (``LOG_INDEX``), from the written files' ``log_id`` column alone.
    """
    (
        by_month(df, day)
        .sortWithinPartitions("usage_month", "account_id")
        .write.mode("overwrite")
        .option("compression", CODEC)
        .partitionBy("usage_month")
        .parquet(path)
    )
    written = df.sparkSession.read.parquet(path)
    if "log_id" in written.columns:
        write_index(written, path)


def write_index(rows: DataFrame, path: str, months: list[date] | None = None) -> None:
    """The id index of ``rows`` (log_id, usage_month); with ``months`` only those months' index partitions are replaced,
    and a listed month without rows gets an empty one. Without ``months`` the rows are a written table's, whose files hold a month
    each, so every task writes the index of its own files and nothing is shuffled."""
    index = rows.select(F.xxhash64("log_id").alias("h"), "usage_month")
    if months is None:
        index.sortWithinPartitions("usage_month", "h").write.mode("overwrite").partitionBy("usage_month").parquet(f"{path}/{LOG_INDEX}")
        return
    index = index.hint("rebalance", F.col("usage_month")).sortWithinPartitions("usage_month", "h")
    writer = index.write.mode("overwrite").partitionBy("usage_month")
    writer.option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{LOG_INDEX}")
    held = {r[0] for r in rows.select("usage_month").distinct().collect()}
    for month in sorted(set(months) - held):
        index.where("false").drop("usage_month").write.mode("overwrite").parquet(
            f"{path}/{LOG_INDEX}/usage_month={month.isoformat()}")


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The id index of a usage table, or None for a table written without one."""
    try:
        return spark.read.schema("h long, usage_month date").parquet(f"{path}/{LOG_INDEX}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_clustered(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """Bucketed by account, for joins on account that need no shuffle."""
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, "account_id").sortBy("account_id").saveAsTable(
        table
    )


def merge_usage(spark: SparkSession, path: str, incoming: DataFrame, day: str = "usage_date") -> None:
    """Replace only the months that hold an incoming log or will hold one; an incoming log wins over a stored one.

    A log whose day moved to another month leaves its old month. Of several incoming versions of a log the one with the latest day,
    then the most credits, is kept. The months that hold an incoming id come from the id index, so the usage rows of other
    months are never read (a hash that two ids share only adds a month, which is then written back as it was); a table
    without an index is searched by a semi join instead. The touched months are few and bounded by the calendar, so they
    are the one thing read to the driver, which lets the stored side prune partitions. The index of the touched months is
    replaced after the data.
    """
    versions = W.partitionBy("log_id").orderBy(F.desc(day), F.desc("credits_consumed"), F.desc("account_id"))
    fresh = incoming.withColumn("_v", F.row_number().over(versions)).where("_v = 1").drop("_v")
    fresh = fresh.withColumn("usage_month", F.trunc(day, "month")).checkpoint()
    # the batch's schema, so that no footer of the stored files is read to infer one
    stored = spark.read.schema(fresh.schema).parquet(path)
    ids = fresh.select("log_id")
    index = read_index(spark, path)
    if index is None:
        held = stored.join(ids, "log_id", "left_semi").select("usage_month")
    else:
        held = index.join(fresh.select(F.xxhash64("log_id").alias("h")), "h", "left_semi").select("usage_month")
    touched = fresh.select("usage_month").unionByName(held)
    months = [r[0] for r in touched.distinct().collect()]
    kept = stored.where(F.col("usage_month").isin(months)).join(ids, "log_id", "left_anti")
    # The read partitions are the ones replaced, so the merged rows are cut from the old files first.
    merged = kept.unionByName(fresh).checkpoint()
    # A month that keeps no log has nothing to be written over it; its folder is replaced by an empty file set.
    left = {r[0] for r in merged.select("usage_month").distinct().collect()}
    (
        by_month(merged, day)
        .sortWithinPartitions("usage_month", "account_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("usage_month")
        .parquet(path)
    )
    for month in sorted(set(months) - left):
        empty = merged.where("false").drop("usage_month")
        empty.write.mode("overwrite").parquet(f"{path}/usage_month={month.isoformat()}")
    if index is not None:
        write_index(merged, path, months)


class MonthClosed(Exception):
    """Raised when a published month would be written again."""


def published_months(spark: SparkSession, path: str, month: str = "month_end") -> list[date]:
    """Months that hold published rows, from the folder names alone."""
    try:
        return sorted(r[0] for r in spark.read.parquet(path).select(month).distinct().collect())
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return []
        raise


def publish_months(df: DataFrame, path: str, gathered: bool = False) -> list[date]:
    """Write the month-ends of ``df`` that aren't published yet, in one job. Returns those that are: they stay as they are.
    ``gathered``: the rows of a month are together already.

    A write that fails halfway leaves nothing behind, as files are moved into place when the job commits.
    """
    closed = published_months(df.sparkSession, path)
    if closed:
        # the months alone first: rows of closed ones are not worked out only to be refused
        asked = {r[0] for r in df.select("month_end").distinct().collect()}
        refused = sorted(asked & set(closed))
        if not asked - set(closed) - {None}:
            return refused
    fresh = df.where(~F.col("month_end").isin(closed)) if closed else df
    fresh = fresh if gathered else fresh.hint("rebalance", F.col("month_end"))
    fresh.write.mode("append").option("compression", CODEC).partitionBy("month_end").parquet(path)
    # the digest of each month as published, from the written rows, for later runs to compare with
    written = df.sparkSession.read.parquet(path)
    new = written.where(~F.col("month_end").isin(closed)) if closed else written
    digests = month_digest(new)
    if not digests.isEmpty():
        digests.write.mode("append").parquet(f"{path}/{DIGESTS}")
    return refused if closed else []


#: Digests of published months, beside them; the leading underscore hides the folder from readers of the months.
DIGESTS = "_digests"


def month_digest(df: DataFrame, month: str = "month_end") -> DataFrame:
    """An order-free digest per month: the row count and the sums of the two 32-bit halves of a 64-bit hash of each row's
    columns (by name). Sums of halves are exact, so the digest depends on the rows only, never on their order or their
    partitions; a changed value, a lost row or an extra row changes it."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c != month])
    return df.groupBy(month).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("hi"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"),
    )


def changed_months(df: DataFrame, path: str, month: str = "month_end") -> DataFrame:
    """Months of ``df`` against the digests written when they were published: (month, n_rows, matches). Only the small
    digest table is read, never the published rows; a month published without a digest does not match."""
    stored = df.sparkSession.read.parquet(f"{path}/{DIGESTS}").select(
        month, F.col("n_rows").alias("_n"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
    now = month_digest(df, month)
    same = (F.col("n_rows") == F.col("_n")) & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
    return now.join(stored, month, "left").select(month, "n_rows", F.coalesce(same, F.lit(False)).alias("matches"))


def publish_month(df: DataFrame, path: str, month: date) -> None:
    """Write one month-end snapshot once. A second write for the same month fails and changes nothing."""
    if publish_months(df.where(F.col("month_end") == F.lit(month)), path):
        raise MonthClosed(f"{month} is already published at {path}")


def append_results(df: DataFrame, path: str, schema: T.StructType, run: dict[str, Column]) -> None:
    """Append one run's rows to a result table; ``run`` gives the run columns, never a clock."""
    for name, value in run.items():
        df = df.withColumn(name, value)
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    df.select(*cols).write.mode("append").parquet(path)


def put_run(df: DataFrame, path: str, schema: T.StructType, run: dict[str, Column], month_of: str = "run_ts") -> None:
    """One run's rows in its own folder ``run_month=.../run_id=...``: a run written again replaces only its own rows.

    Runs are kept apart by folder, so two runs written at once touch different folders; ``run_month`` lets retention
    expire whole months of runs (``retention.expire_months``). Read back with ``read_runs``.
    """
    for name, value in run.items():
        df = df.withColumn(name, value)
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    (
        df.select(*cols, F.trunc(F.to_date(month_of), "month").alias("run_month"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_month", "run_id").parquet(path)
    )


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table written by ``put_run``, with the types of ``schema`` (folder names are not guessed at) and ``run_month``."""
    full = T.StructType([f for f in schema.fields if f.name != "run_id"]
                        + [T.StructField("run_month", T.DateType()), T.StructField("run_id", T.StringType())])
    return spark.read.schema(full).parquet(path).select(*schema.names, "run_month")


def export_csv(df: DataFrame, path: str, order: list[Column], limit: int | None = None) -> None:
    """A table view as CSV files that follow each other in the given order: all rows, or the first ``limit`` if one is given."""
    rows = df.orderBy(*order)
    rows = rows if limit is None else rows.limit(limit)
    rows.write.mode("overwrite").option("header", True).csv(path)
