"""Streaming front end: an event stream becomes daily usage per account.

Two ways, for two readers. ``land`` appends every event to a table by day, without state: open days are there at once, late
events are further rows of their day, and ``reconciled`` counts repeated events once and sums per day, so that the events of the
stream and those of the roll-up are the same. ``daily_rollup`` is the low-latency one: events are de-duplicated by id
within the watermark and summed in one-day tumbling windows, and a row is emitted once, when the watermark passes
the end of its day; what comes later shows in the reconciled table only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.fixture import padded

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
LATENESS = "2 days"


def read_events(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def usage_events(events: DataFrame) -> DataFrame:
    """Events as usage of an account. The session time zone must be UTC, so that a window is a calendar day."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        padded("ACC", F.col("user_id"), 8).alias("account_id"),
        F.col("value").cast("decimal(18,2)").alias("credits"),
    )


def land(usage: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all events to a table partitioned by day, each exactly once; processes everything available, then stops."""
    return (
        usage.withColumn("usage_date", F.to_date("event_time"))
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("usage_date")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def landed(spark: SparkSession, out: str) -> DataFrame:
    schema = "event_id long, event_time timestamp, account_id string, credits decimal(18,2), usage_date date"
    return spark.read.schema(schema).parquet(out)


def reconciled(events: DataFrame) -> DataFrame:
    """One row per (account, day); an event that was sent again counts once, on its first day."""
    first = F.min(F.struct("usage_date", "event_time", "account_id", "credits"))
    once = events.groupBy("event_id").agg(first.alias("e")).select("e.*")
    return once.groupBy("usage_date", "account_id").agg(
        F.count("*").alias("n_logs"), F.sum("credits").alias("credits_consumed")
    )


def daily_rollup(usage: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Works on a stream and, unchanged, on a batch (where the watermark has no effect)."""
    marked = usage.withWatermark("event_time", lateness)
    once = marked.dropDuplicatesWithinWatermark(["event_id"]) if usage.isStreaming else marked.dropDuplicates(["event_id"])
    return (
        once.groupBy(F.window("event_time", "1 day").alias("w"), "account_id")
        .agg(F.count("*").alias("n_logs"), F.sum("credits").alias("credits_consumed"))
        .select(F.to_date("w.start").alias("usage_date"), "account_id", "n_logs", "credits_consumed")
    )


def start(rollup: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append closed days to a parquet table; processes everything available, then stops."""
    return (
        rollup.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
