"""Token counts without tokens: count-only Viterbi over the matches of an Aho-Corasick automaton.

The automaton reports every vocabulary piece that ends at a position, the longest first. For each position the search keeps only the best
score and the number of pieces on that path. The vocabulary and its tie rules are those of ``pieces.py``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table
from .pieces import DEFAULT, MARK, Memo, Vocabulary, vocabulary


class Counter:
    def __init__(self, words: Vocabulary):
        self.words = words
        self.automaton = ahocorasick.Automaton()
        for piece, i in words.matchable.items():
            self.automaton.add_word(piece, (len(piece), words.scores[i]))
        self.automaton.make_automaton()
        self.memo = Memo(self.chunk_count)

    def chunk_count(self, chunk: str) -> int:
        """Pieces of the best segmentation of one chunk, spaces being markers."""
        words = self.words
        # a marker of the text itself takes the place of a character that no piece has
        marked = chunk.replace(MARK, "\0").replace(" ", MARK)
        n = len(marked)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        done = 0  # positions up to here are final
        filled = [False] * (n + 1)
        single = [False] * (n + 1)

        def close(end: int) -> None:
            """Positions after ``done`` up to ``end`` have all their matches; adds unknown characters where allowed."""
            for e in range(done + 1, end + 1):
                if not single[e]:
                    value = best[e - 1] + words.unknown_score
                    if not filled[e] or value > best[e]:
                        best[e], filled[e] = value, True
                        count[e] = count[e - 1] + len(words.spell(chunk[e - 1]))

        for last, (length, score) in self.automaton.iter(marked):
            end = last + 1
            if end - 1 > done:
                close(end - 1)
                done = end - 1
            value = best[end - length] + score
            if length == 1:
                single[end] = True
            if not filled[end] or value > best[end]:
                best[end], count[end], filled[end] = value, count[end - length] + 1, True
        close(n)
        return count[n]

    def count(self, text: str | None) -> int:
        """0 for a null or empty text."""
        return sum(map(self.memo.__getitem__, self.words.chunk.findall(" " + text))) if text else 0


@lru_cache(maxsize=2)
def counter(path: str = DEFAULT) -> Counter:
    return Counter(vocabulary(path))


def counts(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have 0 tokens. Repeated rows give repeated results, an empty table none; other columns are ignored.
    ``path`` is the vocabulary file, at the same place on every executor.
    """
    ready(docs.sparkSession)

    @F.arrow_udf("long")
    def n_tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for texts in parts:
            yield pa.array(np.fromiter((own.count(t.as_py()) for t in texts), np.int64, len(texts)))

    return docs.select("doc_id", n_tokens.asNondeterministic()("text").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))
