"""Daily usage as an incremental table: each micro-batch upserts only the (account, day) rows it touches.

Two tables under one folder, both updated by ``foreachBatch``:

* ``first``: the first copy of every event (smallest day, time, account, credits), partitioned by a hash bucket of the
  event id. A row remembers the batch that last set it and its value before that batch.
* ``daily``: (usage_date, account_id, n_logs, credits_consumed), partitioned by day; every row of a day carries the last
  batch applied to that day (``through_batch``).

A batch looks up its ids in the buckets it touches only, works out what changes (a new event adds to its day; an earlier
copy of a known event moves it; a later copy changes nothing), and rewrites the touched buckets and days. It is safe to
run a batch again after a stop at any point: ``first`` rows set by that same batch are read as their value before it, and a
day already stamped with the batch is not added to twice. Late events are counted like any other: nothing is dropped by
a watermark. The result equals ``rollup.reconciled`` over all events seen.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import ready_for_checkpoint

BUCKETS = 64
COPY = "struct<usage_date:date,event_time:timestamp,account_id:string,credits:decimal(18,2)>"
FIRST = f"event_id long, cur {COPY}, prev {COPY}, set_batch long, bucket int"
DAILY = "account_id string, n_logs long, credits_consumed decimal(28,2), through_batch long, usage_date date"


def _read(spark: SparkSession, path: str, schema: str, column: str, values: list) -> DataFrame:
    """Partitions ``values`` of a table, or an empty frame if it has none yet."""
    try:
        return spark.read.schema(schema).parquet(path).where(F.col(column).isin(values))
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise


def _write(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def upsert(batch: DataFrame, batch_id: int, folder: str, buckets: int = BUCKETS) -> None:
    """Apply one batch of usage events (event_id, event_time, account_id, credits) to the tables under ``folder``."""
    spark = batch.sparkSession
    ready_for_checkpoint(spark)
    copy = F.struct(F.to_date("event_time").alias("usage_date"), "event_time", "account_id", "credits")
    incoming = (
        batch.groupBy("event_id").agg(F.min(copy).alias("new"))
        .withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int"))
        .checkpoint()
    )
    touched = [r[0] for r in incoming.select("bucket").distinct().collect()]  # at most ``buckets`` values
    if not touched:
        return
    stored = _read(spark, f"{folder}/first", FIRST, "bucket", touched).checkpoint()
    # as before this batch: a row that this same batch set (a run again after a stop) counts as its earlier value
    before = stored.select("event_id", F.when(F.col("set_batch") == batch_id, F.col("prev")).otherwise(F.col("cur")).alias("old"))
    met = incoming.join(before, "event_id", "left")
    moves = met.where(F.col("old").isNull() | (F.col("new") < F.col("old"))).checkpoint()

    gain = moves.select("new.usage_date", "new.account_id", F.lit(1).alias("n"), F.col("new.credits").alias("c"))
    loss = moves.where(F.col("old").isNotNull()).select(
        "old.usage_date", "old.account_id", F.lit(-1).alias("n"), (-F.col("old.credits")).alias("c"))
    deltas = gain.unionByName(loss).groupBy("usage_date", "account_id").agg(
        F.sum("n").alias("dn"), F.sum("c").alias("dc")).checkpoint()
    days = [r[0] for r in deltas.select("usage_date").distinct().collect()]  # the days of one batch
    if days:
        old_days = _read(spark, f"{folder}/daily", DAILY, "usage_date", days).checkpoint()
        applied = {r[0] for r in old_days.where(F.col("through_batch") >= batch_id).select("usage_date").distinct().collect()}
        due = [d for d in days if d not in applied]
        if due:
            cur = old_days.where(F.col("usage_date").isin(due))
            add = deltas.where(F.col("usage_date").isin(due))
            new_days = (
                cur.join(add, ["usage_date", "account_id"], "full")
                .select(
                    "usage_date", "account_id",
                    (F.coalesce("n_logs", F.lit(0)) + F.coalesce("dn", F.lit(0))).cast("long").alias("n_logs"),
                    (F.coalesce("credits_consumed", F.lit(0)) + F.coalesce("dc", F.lit(0))).cast("decimal(28,2)")
                    .alias("credits_consumed"),
                    F.lit(batch_id).cast("long").alias("through_batch"),
                )
            )
            _write(new_days, f"{folder}/daily", "usage_date")

    changed = moves.select(
        "event_id", F.col("new").alias("cur"), F.col("old").alias("prev"), F.lit(batch_id).cast("long").alias("set_batch"),
        "bucket")
    kept = stored.join(changed.select("event_id"), "event_id", "left_anti")
    _write(kept.unionByName(changed), f"{folder}/first", "bucket")


def read_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The daily table: (usage_date, account_id, n_logs, credits_consumed); days whose events all moved away are left out."""
    rows = spark.read.schema(DAILY).parquet(f"{folder}/daily").where("n_logs > 0")
    return rows.select("usage_date", "account_id", "n_logs", F.col("credits_consumed").cast("decimal(28,2)"))


def start(usage: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert every micro-batch of usage events; processes everything available, then stops."""
    return (
        usage.writeStream.foreachBatch(lambda df, i: upsert(df, i, folder, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
