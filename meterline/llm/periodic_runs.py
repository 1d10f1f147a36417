"""Periodic run detection over the words of each document: descending-LCP Kruskal over the suffix array.

The words of a document become integers, and their suffix array and the longest common prefix (LCP) of neighbouring suffixes
come from prefix doubling in numpy. Neighbours in the suffix array are then united in decreasing order of their LCP with
union-find; each class holds the sorted set of text positions of its suffixes. When two classes meet at LCP ``L``, every
position of the smaller class is looked up in the larger one: a predecessor or successor at distance ``d <= L`` shares ``L``
words with it, so the stretch ``[a, a + d + L)`` has period ``d`` and cannot be extended to the right. If it cannot be
extended to the left either, it is kept with period ``d``; of the periods found for one stretch the smallest is its own.
Every run is found this way: its first position and the one a period later become neighbours in their class at exactly that
level. Only levels of 6 and more are needed, as a run of 12 words or more has ``L >= 6``.

A run: consecutive words with smallest period ``q``, length at least ``max(12, 2q)``, that no neighbouring word extends
keeping period ``q``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table

# Fixed values of the contract.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHORTEST = 12
PLANT_FOLDS = 10  # documents with crc32(doc_id) % 10 == 0 get a periodic tail
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

OUT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words after the contract's edit: a periodic tail for one document in ten by crc32 of its id; null ids untouched."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % PLANT_FOLDS:
        return words
    g = h // PLANT_FOLDS
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def suffix_array(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP of neighbours (``lcp[i]`` between ``sa[i - 1]`` and ``sa[i]``, ``lcp[0] = 0``)."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64).reshape(-1)
    levels = [rank]
    k = 1
    sa = np.argsort(rank, kind="stable")
    while k < n and len(np.unique(rank)) < n:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 1) + second + 1
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        levels.append(rank)
        k *= 2
    lcp = np.zeros(n, np.int64)
    if n > 1:
        x, y = sa[:-1].copy(), sa[1:].copy()
        got = np.zeros(n - 1, np.int64)
        # levels[j] tells whether 2**j words agree; the last level never does for two different suffixes
        for j in range(len(levels) - 2, -1, -1):
            step = 1 << j
            inside = (x < n) & (y < n)
            xs, ys = np.minimum(x, n - 1), np.minimum(y, n - 1)
            ok = inside & (levels[j][xs] == levels[j][ys])
            got += ok * step
            x += ok * step
            y += ok * step
        lcp[1:] = got
    return sa, lcp


class Ordered:
    """A sorted set of ints in blocks: neighbours and inserts cost a bisection and a short list move."""

    LOAD = 256

    def __init__(self, first: int):
        self.blocks, self.firsts, self.size = [[first]], [first], 1

    def neighbours(self, x: int) -> tuple[int | None, int | None]:
        b = bisect_right(self.firsts, x) - 1
        if b < 0:
            return None, self.blocks[0][0]
        block = self.blocks[b]
        j = bisect_left(block, x)
        before = block[j - 1] if j > 0 else (self.blocks[b - 1][-1] if b > 0 else None)
        after = block[j] if j < len(block) else (self.blocks[b + 1][0] if b + 1 < len(self.blocks) else None)
        return before, after

    def add(self, x: int) -> None:
        b = max(bisect_right(self.firsts, x) - 1, 0)
        block = self.blocks[b]
        insort(block, x)
        self.firsts[b] = block[0]
        if len(block) > 2 * self.LOAD:
            self.blocks[b : b + 1] = [block[: self.LOAD], block[self.LOAD :]]
            self.firsts[b : b + 1] = [block[0], block[self.LOAD]]
        self.size += 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def runs(words: list) -> list[tuple[int, int, int]]:
    """All runs of a sequence as (start, length, period), by start, then period."""
    n = len(words)
    if n < SHORTEST:
        return []
    ids: dict = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    sa, lcp = suffix_array(seq)
    least = (SHORTEST + 1) // 2
    edges = np.nonzero(lcp >= least)[0]
    if not len(edges):
        return []
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent = list(range(n))
    sets: dict[int, Ordered] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    found: dict[tuple[int, int], int] = {}
    for i in edges.tolist():
        level = int(lcp[i])
        x, y = find(int(sa[i - 1])), find(int(sa[i]))
        sx, sy = sets.get(x) or Ordered(x), sets.get(y) or Ordered(y)
        if sx.size > sy.size:
            x, y, sx, sy = y, x, sy, sx
        for p in sx:
            for q in sy.neighbours(p):
                if q is None:
                    continue
                a, d = min(p, q), abs(p - q)
                if d <= level and (a == 0 or seq[a - 1] != seq[a - 1 + d]) and d + level >= SHORTEST:
                    end = a + d + level
                    if found.get((a, end), d + 1) > d:
                        found[(a, end)] = d
        for p in sx:
            sy.add(p)
        parent[x] = y
        sets[y] = sy
        sets.pop(x, None)
    return sorted(((a, end - a, d) for (a, end), d in found.items()), key=lambda r: (r[0], r[2]))


def summary(words: list[str]) -> dict:
    """Runs, the longest run (ties: smallest start, then period) and the digests of the contract.

    No words, or no run: ``n_runs`` 0, four nulls, the hash of the empty string for the runs, and the words as they are.
    """
    found = runs(words)
    dropped = np.zeros(len(words), bool)
    for start, length, period in found:
        dropped[start + period : start + length] = True
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for w, gone in zip(words, dropped) if not gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return {
        "n_words": len(words),
        "n_runs": len(found),
        "start": best[0] if best else None,
        "length": best[1] if best else None,
        "period": best[2] if best else None,
        "exponent_milli": (1000 * best[1]) // best[2] if best else None,
        "runs_sha256": hashlib.sha256(listing.encode("utf-8")).hexdigest(),
        "collapsed_sha256": hashlib.sha256(kept.encode("utf-8")).hexdigest(),
    }


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            text = None if text is None or (isinstance(text, float) and np.isnan(text)) else text
            rows.append({"doc_id": doc_id} | summary(planted(words_of(text), doc_id)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype(
            {"start": "Int64", "length": "Int64", "period": "Int64", "exponent_milli": "Int64", "doc_id": "Int64"})


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (its ``doc_id`` and ``text``; other columns are not read): runs of its words.

    The contract's periodic tail is put into one document in ten first (null ids never). Null or empty text: no words, no
    runs. Repeated rows give repeated, equal results. A document is handled by one task, whole.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_summaries, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
