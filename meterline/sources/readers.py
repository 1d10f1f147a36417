"""Readers with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from .schemas import ACCOUNT_ARCHETYPES, FREE_TEXT, SOURCES


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header row skipped, malformed rows rejected.

    Quoted newlines are kept in tables with names typed by people; such a file can't be split. The others, the
    usage logs among them, are read in pieces.
    """
    free_text = any(f.name in FREE_TEXT for f in schema.fields)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", free_text)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_sources(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The four source tables stored under ``folder/<table>``."""
    read = read_csv if fmt == "csv" else read_parquet
    return {name: read(spark, f"{folder}/{name}", schema) for name, schema in SOURCES.items()}


def read_labels(spark: SparkSession, parquet_path: str, csv_path: str) -> DataFrame:
    """Ground-truth labels: parquet first, then CSV, else an error (never an empty table)."""
    for read, path in ((read_parquet, parquet_path), (read_csv, csv_path)):
        try:
            return read(spark, path, ACCOUNT_ARCHETYPES)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no label table at {parquet_path} or {csv_path}")


def register_raw_views(sources: dict[str, DataFrame]) -> None:
    """``raw_<table>`` views for SQL users."""
    for name, df in sources.items():
        df.createOrReplaceTempView(f"raw_{name}")
