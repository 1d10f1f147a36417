"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, documents drawn without regard to their label the unlabelled set. A linear
model over hashed words and word beginnings minimises the risk

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

with the logistic loss. The second term estimates the risk on clean documents; where it falls below zero the model overfits,
and the step goes the other way (Kiryo et al.).

Documented bounds: at most ``POSITIVES`` and ``UNLABELLED`` documents teach the model and ``FEATURES`` features carry a
weight. Scores always cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, ready, sample, sigmoid, table, texts_of
from .hashing import word_hashes

POSITIVES = 2000
UNLABELLED = 4000
FEATURES = 1024
HEADS = (4, 5, 6, 8, 10)
TRIM = 3
STEPS = 400
RATE = 0.05
RIDGE = 2e-4
FILTER_BITS = 20


def hashed_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Feature hashes of all words without signs at their ends, then of the beginnings of each length; each array is aligned with
    the words."""
    heads: list[np.ndarray] = []
    words, at = word_hashes(texts, HEADS, heads, TRIM)
    yield at
    yield words
    yield from heads


def counted(texts: pa.Array, vocabulary: np.ndarray, seen: np.ndarray | None = None):
    """(row, feature, count) of the features of a sorted vocabulary, and the words of each row."""
    source = hashed_features(texts)
    at = next(source)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if seen is None:
        seen = filter_of(vocabulary)
    cells = []
    for values in source:
        hit = np.flatnonzero(seen[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(vocabulary, values[hit]), max(len(vocabulary) - 1, 0))
        if len(vocabulary):
            real = vocabulary[place] == values[hit]
            cells.append(owner[hit[real]] * len(vocabulary) + place[real])
    cell, count = np.unique(np.concatenate(cells) if cells else np.zeros(0, np.int64), return_counts=True)
    wide = max(len(vocabulary), 1)
    return cell // wide, cell % wide, count, np.diff(at)


def filter_of(vocabulary: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(vocabulary >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return seen


def vocabulary_of(positive: pa.Array, unlabelled: pa.Array, most: int = FEATURES) -> np.ndarray:
    """The features that are over-represented in positives, by the two-sample z value of their document shares."""

    def document_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        per_text = []
        for i in range(0, len(texts), 200):
            source = hashed_features(texts.slice(i, 200))
            at = next(source)
            arrays = list(source)
            for a, b in zip(at[:-1], at[1:]):
                per_text.append(np.unique(np.concatenate([x[a:b] for x in arrays])))
        values, counts = np.unique(np.concatenate(per_text), return_counts=True) if per_text else (np.zeros(0, np.uint64),) * 2
        return values[values > 0], counts[values > 0].astype(float)

    values, n = document_counts(positive)
    enough = n >= max(3, 0.004 * len(positive))
    values, n = values[enough], n[enough]
    other, m_all = document_counts(unlabelled)
    m = np.zeros(len(values))
    if len(other):
        place = np.minimum(np.searchsorted(other, values), len(other) - 1)
        m = np.where(other[place] == values, m_all[place], 0.0)
    p, q = n / max(len(positive), 1), m / max(len(unlabelled), 1)
    both = (n + m + 1) / (len(positive) + len(unlabelled) + 2)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / max(len(positive), 1) + 1 / max(len(unlabelled), 1)))
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(values[best[z[best] > 2.0]])


def matrix(texts: pa.Array, vocabulary: np.ndarray) -> np.ndarray:
    """log(1 + count) of each feature, log(1 + words) and a constant."""
    out = np.zeros((len(texts), len(vocabulary) + 2), np.float32)
    for i in range(0, len(texts), 200):
        row, feature, count, words = counted(texts.slice(i, 200), vocabulary)
        out[row + i, feature] = np.log1p(count)
        out[i : i + len(words), -2] = np.log1p(words)
    out[:, -1] = 1.0
    return out


def minimise(pos: np.ndarray, unl: np.ndarray, prior: float) -> np.ndarray:
    """Adam steps on the non-negative risk."""
    w = np.zeros(pos.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        fp, fu = pos @ w, unl @ w
        clean_risk = np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp))
        clean_slope = unl.T @ sigmoid(fu) / len(unl) - prior * (pos.T @ sigmoid(fp)) / len(pos)
        if clean_risk >= 0:
            slope = prior * (pos.T @ (sigmoid(fp) - 1)) / len(pos) + clean_slope
        else:
            slope = -clean_slope
        slope = (slope + RIDGE * np.append(w[:-1], 0.0)).astype(np.float32)
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope * slope
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w.astype(float)


class Model:
    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights

    def scores(self, texts: pa.Array, seen: np.ndarray | None = None) -> np.ndarray:
        row, feature, count, words = counted(texts, self.vocabulary, seen)
        f = np.bincount(row, self.weights[feature] * np.log1p(count), len(words)) if len(row) else np.zeros(len(words))
        return sigmoid(f + self.weights[-2] * np.log1p(words) + self.weights[-1])

    def score_column(self, text: str = "text"):
        model = self

        @F.arrow_udf("double")
        def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            seen = filter_of(model.vocabulary)
            for texts in parts:
                yield pa.array(model.scores(texts, seen))

        return score.asNondeterministic()(F.col(text))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns outside the held-out fold (crc32 of the id modulo 5 is 0). The class prior is the share of toxic rows among
    the labelled ones there. Without positives nothing is toxic; null labels and null texts teach nothing."""
    known = labels.filter((fold("doc_id", 5) != 0) & F.col("toxic").isNotNull())
    n, toxic = known.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    prior = min(max((toxic or 0) / max(n, 1), 1e-3), 0.5)

    def arrow(ids: list[int]) -> pa.Array:
        found = texts_of(docs, ids)
        return pa.array([found[i] for i in ids if i in found], pa.large_string())

    pos = arrow(sample(known.filter("toxic = 1"), POSITIVES))
    unl = arrow(sample(docs.filter(fold("doc_id", 5) != 0), UNLABELLED))
    if not len(pos) or not len(unl):
        return Model(np.zeros(0, np.uint64), np.array([0.0, np.log(prior / (1 - prior))]))
    vocabulary = vocabulary_of(pos, unl)
    return Model(vocabulary, minimise(matrix(pos, vocabulary), matrix(unl, vocabulary), prior))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have no features and get the model's constant. Repeated rows give repeated results, an empty table none;
    other columns are ignored. A null id is not held out and never learned from.
    """
    ready(docs.sparkSession)
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text").withColumn("score", model.score_column())
    return rows.select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
