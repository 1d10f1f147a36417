"""From raw documents to token ids, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.llm import language, mixing, near_duplicates, quality, sentence_pieces
from meterline.llm.common import table
from meterline.session import scratch_path

STAGES = [
    ("quality", quality.stage),
    ("language", language.stage),
    ("near_duplicates", near_duplicates.stage),
    ("mixing", mixing.stage),
    ("sentence_pieces", sentence_pieces.stage),
]

#: Learned models and byte-pair pieces aren't expressible in SQL; tests/llm holds a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(path := scratch_path(spark, f"stage-{name}"))
            docs = spark.read.parquet(path)
    return docs
