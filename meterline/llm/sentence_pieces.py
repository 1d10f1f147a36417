"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of the pieces.

The trie keeps its states in two flat arrays: the child of state s by symbol c is base[s] + c if check[there] is s. A
position's matches are found by one walk from it. The vocabulary, scores, tie rules and byte fallback are those of ``pieces.py``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table
from .pieces import BYTE, CONTROL, DEFAULT, MARK, Memo, Vocabulary, vocabulary


class DoubleArray:
    """Strings with a number each; symbols are the characters that occur, numbered from 1."""

    def __init__(self, entries: dict[str, int]):
        self.symbol = {c: i + 1 for i, c in enumerate(sorted(set("".join(entries))))}
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for text, number in entries.items():
            node = 0
            for c in text:
                s = self.symbol[c]
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][s]
            value[node] = number
        wide = len(self.symbol) + 1
        span = 2 * len(children) + 4 * wide
        free = np.ones(span, bool)
        free[0] = False
        place: dict[int, int] = {}
        low, window = 1, 2048
        # states with most children first, each at the first place where all of its children fit
        for node in sorted((n for n in range(len(children)) if len(children[n]) > 1), key=lambda n: -len(children[n])):
            wanted = np.array(sorted(children[node]))
            at = max(low, int(wanted[0]))
            while True:
                if at + window + wide > len(free):
                    free = np.concatenate([free, np.ones(span + window, bool)])
                spots = np.flatnonzero(free[at : at + window]) + at
                fits = np.flatnonzero(free[spots[:, None] + (wanted - wanted[0])[None, :]].all(1))
                if len(fits):
                    place[node] = int(spots[fits[0]]) - int(wanted[0])
                    free[place[node] + wanted] = False
                    break
                at += window
            while free[low : low + 256].sum() < 16 and low + 256 < len(free):
                low += 256
        free = np.concatenate([free, np.ones(span, bool)])
        spare = iter(np.flatnonzero(free).tolist())
        for node in range(len(children)):
            if len(children[node]) == 1:
                (s,) = children[node]
                b = next(x for x in spare if x >= s) - s
                free[b + s] = False
                place[node] = b
        size = int(np.flatnonzero(~free)[-1]) + wide + 1  # every walk stays inside
        base, check, number = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        state = {0: 0}
        for node in range(len(children)):
            own = state[node]
            base[own] = place.get(node, 0)
            number[own] = value[node]
            for s, child in children[node].items():
                state[child] = base[own] + s
                check[base[own] + s] = own
        self.base, self.check, self.number = base, check, number


class Codec:
    def __init__(self, words: Vocabulary):
        self.words = words
        self.trie = DoubleArray(words.matchable)
        self.memo = Memo(self.chunk_ids)
        self.text = [p.replace(MARK, " ") for p in words.pieces]
        self.byte_of = {i: b for b, i in enumerate(words.byte_ids)}

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of the best segmentation of one chunk, spaces being markers."""
        words, trie = self.words, self.trie
        base, check, number, scores = trie.base, trie.check, trie.number, words.scores
        symbols = [0 if c == MARK else trie.symbol.get(MARK if c == " " else c, 0) for c in chunk]
        n = len(symbols)
        best: list[float | None] = [0.0] + [None] * n
        came = [(0, -1)] * (n + 1)
        for start in range(n):
            here = best[start]
            single = False
            state, at = 0, start
            while at < n and symbols[at]:
                to = base[state] + symbols[at]
                if check[to] != state or not to:
                    break
                state, at = to, at + 1
                piece = number[state]
                if piece >= 0:
                    value = here + scores[piece]
                    single = single or at == start + 1
                    if best[at] is None or value > best[at]:
                        best[at], came[at] = value, (start, piece)
            if not single:
                value = here + words.unknown_score
                if best[start + 1] is None or value > best[start + 1]:
                    best[start + 1], came[start + 1] = value, (start, -1)
        out: list[int] = []
        at = n
        while at:
            start, piece = came[at]
            out += [piece] if piece >= 0 else reversed(words.spell(chunk[start:at]))
            at = start
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        return list(chain.from_iterable(map(self.memo.__getitem__, self.words.chunk.findall(" " + text)))) if text else []

    def decode(self, ids) -> str:
        """The text of ids. Control pieces are silent, bytes that are no UTF-8 become U+FFFD, one leading space goes."""
        out: list[str] = []
        pending = bytearray()
        byte_of, text, kinds = self.byte_of, self.text, self.words.kinds
        for i in ids:
            kind = kinds[i]
            if kind == BYTE:
                pending.append(byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if kind != CONTROL:
                out.append(text[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        whole = "".join(out)
        return whole[1:] if whole.startswith(" ") else whole


@lru_cache(maxsize=2)
def codec(path: str = DEFAULT) -> Codec:
    return Codec(vocabulary(path))


def encoded(text: Column, path: str = DEFAULT) -> Column:
    """array<int> of piece ids; empty for null and empty texts."""

    @F.arrow_udf("array<int>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        chunk, look = own.words.chunk.findall, own.memo.__getitem__
        for texts in parts:
            values, ends = [], [0]
            for t in texts:
                raw = t.as_py()
                ids = np.fromiter(chain.from_iterable(map(look, chunk(" " + raw))), np.int32) if raw else np.zeros(0, np.int32)
                values.append(ids)
                ends.append(ends[-1] + len(ids))
            flat = np.concatenate(values) if values else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat))

    return encode.asNondeterministic()(text)


def decoded(ids: Column, path: str = DEFAULT) -> Column:
    """Text of an array of ids; empty for null and empty arrays."""

    @F.arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for rows in parts:
            flat = rows.values.to_numpy()
            ends = rows.offsets.to_numpy()
            yield pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())

    return decode.asNondeterministic()(ids)


def pieces_of(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """The rows of ``docs`` with ``ids`` (array<int>) and ``n_ids``; columns of these names are replaced.

    Null and empty texts have no ids. Repeated rows give repeated results, an empty table none.
    ``path`` is the vocabulary file, at the same place on every executor.
    """
    ready(docs.sparkSession)
    return docs.withColumn("ids", encoded(F.col("text"), path)).withColumn("n_ids", F.size("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every text, and whether decoding them gives the text back."""
    rows = pieces_of(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    back = rows.withColumn("_back", decoded(F.col("ids")))
    return back.select("doc_id", "n_ids", F.xxhash64("ids").alias("ids_digest"), (F.col("_back") == F.col("text")).alias("restored"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces_of(docs)
