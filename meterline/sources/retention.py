"""Expiry of month partitions: aggregate first, then swap the daily detail out, so a stop at any point loses nothing.

A month-partitioned table keeps daily detail for its hot period. A month before the cut-off is first aggregated into an
archive table (one row per key and month, in a partition of that month, written by one job whose commit moves the months
into place), and only then are the detail folders of months that the archive holds deleted. The same job writes a ledger
of the detail files it summed, so a file is never summed twice: a run that stopped while deleting a month's files, or late
detail for a month already archived, is finished by running again, which sums only the files no ledger row names.

The months are read from folder names, a list bounded by the calendar; the detail is read with partition pruning, and the
aggregation is a map-side partial aggregate, so a hot key costs one row per task before the shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import LOG_INDEX


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def month_folders(spark: SparkSession, path: str, column: str) -> dict[date, str]:
    """Month partitions of a table, by folder name ``column=YYYY-MM-DD`` (nested partitions below it are allowed)."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return {}
    found = {}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}="):
            found[date.fromisoformat(name.split("=", 1)[1][:10])] = status.getPath().toString()
    return found


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def expire_months(
    spark: SparkSession,
    path: str,
    archive: str,
    column: str,
    cutoff: date,
    keys: list[str],
    measures: list[Column],
) -> list[date]:
    """Months of ``path`` before ``cutoff``: aggregated into ``archive`` by ``keys``, then their detail deleted.

    ``measures`` are aggregate columns (sums, counts, last values); ``n_detail_rows`` is added. Each write to the archive
    also holds, in the same job, one row per month (keys and measures null) whose ``files`` lists the detail files it
    summed; readers of the archive take the rows where ``files`` is null. A detail file is summed once: a month that has
    detail left after a stop, or late detail, is aggregated from its files that no archive row lists, into another part of
    the month. Returns the months whose detail was removed; nothing before the cut-off: nothing is done.
    """
    detail = month_folders(spark, path, column)
    due = sorted(m for m in detail if m < cutoff)
    if not due:
        return []
    rows = (
        spark.read.option("basePath", path).parquet(*[detail[m] for m in due])
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    if month_folders(spark, archive, column):
        summed = (
            spark.read.parquet(archive).where(F.col(column).isin(due) & F.col("files").isNotNull())
            .select(F.explode("files").alias("_file"))
        )
        rows = rows.join(summed, "_file", "left_anti")
    aggregated = rows.groupBy(column, *keys).agg(*measures, F.count(F.lit(1)).alias("n_detail_rows"))
    aggregated = aggregated.withColumn("files", F.lit(None).cast("array<string>"))
    ledger = rows.groupBy(column).agg(F.array_sort(F.collect_set("_file")).alias("files"))
    written = aggregated.unionByName(ledger, allowMissingColumns=True)
    written.write.mode("append").partitionBy(column).parquet(archive)
    now = month_folders(spark, archive, column)
    index = month_folders(spark, f"{path}/{LOG_INDEX}", column)
    for month in due:
        if month in now:
            delete_folder(spark, detail[month])
            if month in index:  # an id index must not send later merges to a month that is gone
                delete_folder(spark, index[month])
    return [m for m in due if m in now]


def archived(spark: SparkSession, archive: str) -> DataFrame:
    """The aggregate rows of an archive, without its ledger rows."""
    return spark.read.parquet(archive).where(F.col("files").isNull()).drop("files")
