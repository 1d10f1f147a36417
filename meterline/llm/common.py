"""Small helpers shared by the operators."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import scratch_path

BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
TEACH_CHARS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the rows of an Arrow batch, so that long texts don't fill a Python worker."""
    now = int(spark.conf.get(BATCH_KEY, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(BATCH_KEY, str(rows))


def put_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes a file to a fresh path in the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{scratch_path(spark, 'file')}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(content)
    stream.close()
    return path.toString()


@lru_cache(maxsize=8)
def _shipped(app_id: str, spark: SparkSession) -> None:
    root = Path(__file__).resolve().parent.parent
    with zipfile.ZipFile(packed := io.BytesIO(), "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(put_file(spark, f"package-{uuid.uuid4().hex}.zip", packed.getvalue()))


def ready(spark: SparkSession) -> None:
    """Python workers can import this package wherever they run, and get small batches."""
    _shipped(spark.sparkContext.applicationId, spark)
    small_batches(spark)


def fold(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; null for null."""
    return F.crc32(F.col(column).cast("string")) % parts


def drawn(rows: DataFrame, group: str, per_group: int, key: str = "doc_id") -> DataFrame:
    """At most ``per_group`` rows of each value of ``group``, by a fixed pseudo-random order of ``key``.

    The rank limit is applied in every task before the shuffle, so a hot group costs no more than any other.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_group).drop("_rank")


def texts_of(docs: DataFrame, ids: list[int]) -> dict[int, str]:
    """Non-null texts of a bounded list of ids, fetched by a filter that reaches the scan.

    They are for teaching a model on the driver, so of a longer text the first ``TEACH_CHARS`` characters are taken.
    """
    if not ids:
        return {}
    rows = docs.filter(F.col("doc_id").isin(ids) & F.col("text").isNotNull())
    return {r[0]: r[1] for r in rows.select("doc_id", F.substring("text", 1, TEACH_CHARS)).collect()}


def sample(rows: DataFrame, n: int, key: str = "doc_id") -> list[int]:
    """``n`` distinct keys in a fixed pseudo-random order. Repeats are removed before the limit (a partial aggregate in every
    task), so a key repeated on many rows takes one place; every task then keeps its first ``n`` only."""
    keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    return [r[0] for r in keys.orderBy(F.md5(F.col(key).cast("string")), key).limit(n).collect()]


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, so that a helper column never overwrites one of the user's."""
    name = base
    while name in df.columns:
        name = "_" + name
    return name


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
