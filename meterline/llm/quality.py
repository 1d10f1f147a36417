"""Quality classifier by compression: which of two dictionaries makes a text smaller.

Two zstandard dictionaries are built from labelled good and bad text. A text is cut into blocks, each block is compressed
with either dictionary, and x = (size with bad - size with good) / (sum of both) is the normalised difference. A
logistic curve over x, fitted to labelled documents that neither dictionary has seen, turns it into a probability.

Documented bounds: at most ``PER_CLASS`` labelled documents of each class teach the dictionaries and as many the curve, with at most ``TEACH_BYTES`` of
each. Scores always cover whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, fresh_name, ready, sample, sigmoid, table, texts_of

PER_CLASS = 600
TEACH_BYTES = 16_384
DICTIONARY = 64 << 10
BLOCK = 4 << 10
LEVEL = 3


def dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train one."""
    blocks = [b[i : i + BLOCK] for b in (t.encode()[:TEACH_BYTES] for t in texts) for i in range(0, len(b), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(blocks)[-size:]


class Difference:
    """The normalised difference of the compressed sizes of a text."""

    def __init__(self, good: bytes, bad: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False
        )
        self.by = []
        for content in (good, bad):
            shared = zstandard.ZstdCompressionDict(content) if content else None
            self.by.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=params))

    def __call__(self, text: str | None) -> float:
        raw = (text or "").encode()
        if not raw:
            return 0.0
        good, bad = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in self.by)
        return (bad - good) / (bad + good)


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps."""
    if not len(x):
        return 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(design @ w)
        slope = design.T @ (p - y) + ridge * w
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), slope)
    return float(w[0] / scale), float(w[1])


class Model:
    """Dictionaries and curve; small enough to travel with the task."""

    def __init__(self, good: bytes, bad: bytes, slope: float, offset: float):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset

    def score_column(self, text: str = "text"):
        model = (self.good, self.bad)
        slope, offset = self.slope, self.offset

        @F.arrow_udf("double")
        def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            difference = _difference(*model)
            for texts in parts:
                x = np.fromiter((difference(t.as_py()) for t in texts), float, len(texts))
                yield pa.array(sigmoid(slope * x + offset))

        return score.asNondeterministic()(F.col(text))


@functools.lru_cache(maxsize=2)
def _difference(good: bytes, bad: bytes) -> Difference:
    return Difference(good, bad)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from rows of ``labels(doc_id, quality)`` outside the held-out fold (crc32 of the id modulo 3 is 1).

    Null labels and null texts teach nothing. A class without examples has an empty dictionary;
    without labels every score is one half.
    """
    known = labels.filter((fold("doc_id", 3) != 1) & F.col("quality").isNotNull())
    total = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    sets = []
    for q in (1, 0):
        ids = sample(known.filter(F.col("quality") == q), 2 * per_class)
        found = texts_of(docs, ids)
        sets.append([found[i] for i in ids if i in found])
    teach = [texts[::2] for texts in sets]
    good, bad = (dictionary(t) if t else b"" for t in teach)
    difference = Difference(good, bad)
    rest = [texts[1::2] for texts in sets]
    x = [np.array([difference(t) for t in texts]) for texts in rest]
    y = np.concatenate([np.ones(len(x[0])), np.zeros(len(x[1]))])
    slope, offset = curve(np.concatenate(x), y)
    # the sample has about equal numbers of both classes; the offset takes their real shares into account
    drawn = [max(len(v), 1) for v in x]
    offset += float(np.log(max(total.get(1, 0), 1) / max(total.get(0, 0), 1)) - np.log(drawn[0] / drawn[1]))
    return Model(good, bad, slope, offset)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have no difference and get the curve's value at 0. Repeated rows give repeated results, an empty
    table none; other columns are ignored. A null id is not held out and never learned from.
    """
    ready(docs.sparkSession)
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text").withColumn("score", model.score_column())
    return rows.select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is at least one half, with all their columns as they were (a column of the user's
    named like the helper column is left alone). Empty and null texts are scored like any other; an empty table stays empty."""
    ready(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    score = fresh_name(docs, "_quality")
    return docs.withColumn(score, model.score_column()).filter(F.col(score) >= 0.5).select(*docs.columns)
