"""Maps the given star-schema tables to the four source tables (FIXTURES.md).

Every row of supplier, customer, orders and lineitem is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Columns of the given tables that the mapping reads; declared, so that no footer is read to infer a schema.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz,"
    " o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double,"
    " l_shipdate timestamp_ntz",
}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{folder}/{name}.parquet")


def padded(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def sales_reps(spark: SparkSession, folder: str) -> DataFrame:
    place = _read(spark, folder, "nation").join(
        _read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        _read(spark, folder, "supplier")
        .join(place, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            padded("R", F.col("s_suppkey"), 6).alias("rep_id"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("region"),
            F.when(F.col("s_suppkey") % 20 < 9, "Enterprise").otherwise("Mid-Market").alias("segment"),
        )
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    n_reps = _read(spark, folder, "supplier").agg(F.count("*")).scalar()
    return _read(spark, folder, "customer").select(
        padded("ACC", F.col("c_custkey"), 8).alias("account_id"),
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("industry"),
        padded("R", F.col("c_custkey") % n_reps, 6).alias("rep_id"),
    )


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    start = F.to_date("o_orderdate")
    term = F.when(F.col("o_orderpriority") == "1-URGENT", 1080).when(F.col("o_orderpriority") == "2-HIGH", 720)
    return _read(spark, folder, "orders").select(
        padded("CT", F.col("o_orderkey"), 9).alias("contract_id"),
        padded("ACC", F.col("o_custkey"), 8).alias("account_id"),
        start.alias("start_date"),
        F.date_add(start, term.otherwise(360)).alias("end_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("annual_commit_dollars"),
        F.floor(F.col("o_totalprice") / 20).cast("bigint").alias("included_monthly_compute_credits"),
    )


def daily_usage_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All line items. Some carry no account, and every tenth customer reports under an unknown account."""
    # day and credits are made before the join, so that what is shuffled for it is no wider than what is kept
    lines = _read(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").alias("day"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("credits"),
    )
    owner = (
        F.when(F.col("l_orderkey") % 499 == 0, F.lit(None).cast("string"))
        .when(F.col("o_custkey") % 10 == 0, padded("ACC9", F.col("o_custkey"), 7))
        .otherwise(padded("ACC", F.col("o_custkey"), 8))
    )
    holder = _read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(holder, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat_ws(
                "-", F.lit("UL"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("day").cast("string")
            ).alias("log_id"),
            owner.alias("account_id"),
            F.col("day").alias("date"),
            F.col("credits").alias("compute_credits_consumed"),
        )
    )


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "sales_reps": sales_reps(spark, folder),
        "accounts": accounts(spark, folder),
        "contracts": contracts(spark, folder),
        "daily_usage_logs": daily_usage_logs(spark, folder),
    }
