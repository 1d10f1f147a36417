"""Language identification by cross-parsing (Ziv and Merhav).

For each language, labelled text becomes a suffix automaton, which recognises exactly the substrings of that text. A document
is parsed from left to right into longest matches: each phrase is the longest piece, from where the last one
ended, that occurs in the language's text. Phrases times log2 of the length of that text are the bits it takes; the language
that needs the fewest bits wins, ties going to the first by name. A length counts as ``LEAST_TEXT`` at least, 8 bits for a
phrase, or a language with a single short document would win every text by its cheap unknown characters.

Parsing runs in lock step: documents are laid out in lanes of at most ``LANE`` characters and numpy moves all lanes by one
character at a time through the transition table. A phrase also ends where a lane ends, for all languages alike.

Every language that occurs is learned. Tasks build the automata, one for each language; a table holds the moves of all states in
one array (row displacement), so that it takes about a megabyte whatever the alphabet. The tables go to files of ``SHARD``
languages in the shared folder and from there to every executor, where workers memory-map them and parse against one language
after the other: a worker's memory doesn't grow with the number of languages, only the row of counts of each text does.

Documented bounds: at most ``DOCS`` labelled documents of each language, ``CHARS`` characters in all, teach an automaton.
Predictions always cover whole texts.
"""

from __future__ import annotations

import functools
import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import ready_for_checkpoint, scratch_path

from .common import TEACH_CHARS, drawn, fold, fresh_name, ready, table
from .near_duplicates import texts_of
from .url_filter import share

DOCS = 100
CHARS = 30_000
SHARD = 64
LANE = 512
LEAST_MATCH = 1.5
LEAST_TEXT = 256
RESULT = "struct<lang:string,score:double,match:double>"
TABLE = "lang string, length long, symbols binary, base binary, owner binary, to binary"
PARTS = ("symbols", "base", "owner", "to")


class SuffixAutomaton:
    """The smallest automaton of all substrings of a text; state 0 is the empty one."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Table:
    """The moves of an automaton: those of state s by symbol c are ``to[base[s] + c]`` where ``owner`` has s, else there is none.

    ``symbols`` are the code points of the text in ascending order; the symbol after the last stands for all others.
    """

    def __init__(self, length, symbols, base, owner, to):
        self.length, self.symbols, self.base, self.owner, self.to = length, symbols, base, owner, to

    @classmethod
    def of(cls, text: str) -> Table:
        moves = SuffixAutomaton(text).next
        alphabet = {c: i for i, c in enumerate(sorted(set(text)))}
        wide = len(alphabet) + 1
        # no row reaches below slot `wide`, so that no base is negative
        base = np.zeros(len(moves), np.int32)
        used = np.zeros(2 * sum(map(len, moves)) + 4 * wide + 1024, bool)
        used[:wide] = True
        owner, to = np.full(len(used), -1, np.int32), np.full(len(used), -1, np.int32)
        size, low = 0, wide
        for state in sorted((s for s, m in enumerate(moves) if len(m) > 1), key=lambda s: -len(moves[s])):
            row = np.array([alphabet[c] for c in moves[state]], np.int64)
            if len(row) != size:  # rows of one size are laid from left to right, those of the next again from the first gap
                size, low = len(row), wide + int(np.argmin(used[wide:]))
            while True:
                if low + 256 + wide > len(used):
                    more = len(used)
                    used = np.concatenate([used, np.zeros(more, bool)])
                    owner, to = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (owner, to))
                free = ~used[low : low + 256]
                for c in row[1:] - row[0]:
                    at = low + c
                    free = free & ~used[at : at + 256]
                if free.any():
                    low += int(np.argmax(free))
                    break
                low += 256
            base[state] = low - row[0]
            at = base[state] + row
            used[at], owner[at], to[at] = True, state, list(moves[state].values())
        single = np.array([s for s, m in enumerate(moves) if len(m) == 1], np.int64)
        if len(single):
            gaps = np.flatnonzero(~used)[: len(single)]
            if len(gaps) < len(single):
                more = len(single) - len(gaps)
                gaps = np.concatenate([gaps, np.arange(len(used), len(used) + more)])
                owner, to = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (owner, to))
            base[single] = gaps - np.array([alphabet[next(iter(moves[s]))] for s in single])
            owner[gaps], to[gaps] = single, [next(iter(moves[s].values())) for s in single]
        end = int(base.max()) + wide + 1
        owner, to = (np.concatenate([x, np.full(wide + 1, -1, np.int32)])[:end] for x in (owner, to))
        return cls(len(text), np.array(sorted(map(ord, alphabet)), np.int32), base, owner, to)

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = self.base[state] + symbol
        return np.where(self.owner[at] == state, self.to[at], np.int32(-1))

    def symbols_of(self, codes: np.ndarray) -> np.ndarray:
        lookup = np.full(0x110000, len(self.symbols), np.int32)
        lookup[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        return lookup[codes]


class Parser:
    """Counts the phrases of texts in each of the learned languages."""

    def __init__(self, teaching: tuple[tuple[str, str], ...] = ()):
        self.hold([name for name, _ in teaching], [Table.of(text) for _, text in teaching])

    def hold(self, names: list[str], tables: list[Table]) -> Parser:
        self.names, self.tables = names, tables
        self.cost = np.array([np.log2(max(t.length, LEAST_TEXT)) for t in tables])
        return self

    def phrases(self, texts: list[str]) -> np.ndarray:
        """texts x languages."""
        lengths = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not lengths.sum():
            return out
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lanes = -(-lengths // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(np.cumsum(lengths) - lengths, lanes) + nth * LANE
        size = np.minimum(lengths[owner] - nth * LANE, LANE)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        running = np.searchsorted(-size, -np.arange(LANE), "left")  # lanes longer than each step
        for k, moves in enumerate(self.tables):
            symbols = moves.symbols_of(codes)
            state = np.zeros(len(owner), np.int32)
            count = np.zeros(len(owner), np.int32)
            for step in range(int(size[0])):
                n = running[step]
                c = symbols[begin[:n] + step]
                to = moves.move(state[:n], c)
                ended = np.flatnonzero(to < 0)
                if len(ended):
                    # no phrase is open in state 0: the character itself is unknown and is a phrase of its own
                    count[ended] += state[ended] > 0
                    again = moves.move(np.zeros(len(ended), np.int32), c[ended])
                    count[ended] += again < 0
                    to[ended] = np.maximum(again, 0)
                state[:n] = to
            count += state > 0
            out[:, k] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return out


@functools.lru_cache(maxsize=2)
def _opened(index: str) -> Parser:
    """``index``: name, length of the text, file, place in it and sizes of the parts, of each language in order of names."""
    names, tables, files = [], [], {}
    for name, length, file, at, sizes in json.loads(index):
        if file not in files:
            files[file] = np.load(SparkFiles.get(file), mmap_mode="r")
        ends = np.cumsum([at, *sizes])
        names.append(name)
        tables.append(Table(length, *(np.asarray(files[file][i:j]) for i, j in zip(ends, ends[1:]))))
    return Parser().hold(names, tables)


def folded(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def judge(parser: Parser, texts: list[str | None]) -> list[dict]:
    """The result of each text; ``match`` is the mean length of the winner's phrases."""
    clean = [folded(t) if t and any(map(str.isalpha, t)) else "" for t in texts]
    counts = parser.phrases(clean)
    bits = counts * parser.cost
    best = np.argmin(bits, 1)
    rest = bits - bits[np.arange(len(texts)), best][:, None]
    score = 1.0 / np.exp(-np.minimum(rest / parser.cost.max(), 60.0)).sum(1)
    return [
        {"lang": parser.names[b], "score": float(s), "match": len(t) / int(n[b])} if t else {"lang": "und", "score": 0.0, "match": 0.0}
        for t, b, s, n in zip(clean, best, score, counts)
    ]


def taught(docs: DataFrame) -> DataFrame:
    """``lang, text`` of every language of ``docs(doc_id, text, lang)`` outside the held-out fold (crc32 of the id modulo 3 is 1):
    what begins its documents, in order of ids. Null languages and null or blank texts teach nothing, repeated rows no more than one."""
    ready_for_checkpoint(docs.sparkSession)

    @F.arrow_udf("string")
    def head(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([folded(t)[:CHARS] for t in texts.to_pylist()], pa.string())

    known = docs.filter((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    chosen = drawn(known.select("doc_id", "lang").distinct(), "lang", DOCS).checkpoint()
    rows = texts_of(known, chosen.select(F.col("doc_id").alias("id"))).select("doc_id", "lang", F.substring("text", 1, TEACH_CHARS).alias("_t"))
    own = (
        rows.withColumn("_t", head.asNondeterministic()("_t"))
        .join(chosen, ["doc_id", "lang"])
        .groupBy("lang", "doc_id")
        .agg(F.min("_t").alias("_t"))
        .filter("_t <> ''")
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "_t"))).alias("_own"))
    )
    each = F.greatest(F.floor(F.lit(CHARS) / F.size("_own")), F.lit(200)).cast("int")
    text = F.array_join(F.transform("_own", lambda x: x["_t"].substr(F.lit(1), each)), " ")
    return own.select("lang", F.substring(text, 1, CHARS).alias("text"))


def teach(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """(language, text) of each language that ``taught`` finds, for a plain parser."""
    return tuple(sorted((r["lang"], r["text"]) for r in taught(docs).collect()))


def learned(docs: DataFrame) -> str:
    """The index of the tables of all languages, which every executor can then open. Tasks build them; the driver holds the
    tables of one file."""
    spark = docs.sparkSession

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in batch.to_pylist():
                t = Table.of(row["text"])
                values = [[row["lang"]], [t.length], *([getattr(t, k).astype(np.int32).tobytes()] for k in PARTS)]
                kinds = [pa.string(), pa.int64(), *[pa.binary()] * len(PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["lang", "length", *PARTS])

    taught(docs).mapInArrow(build, TABLE).write.parquet(path := scratch_path(spark, "languages"))
    index, waiting = [], []

    def flush() -> None:
        arrays, found, at = [], [], 0
        for r in waiting:
            own = [np.frombuffer(r[k], np.int32) for k in PARTS]
            found.append([r["lang"], r["length"], at, [len(x) for x in own]])
            at += sum(map(len, own))
            arrays += own
        np.save(file := io.BytesIO(), np.concatenate(arrays))
        name = share(spark, {"languages": file.getvalue()})["languages"]
        index.extend([lang, length, name, at, sizes] for lang, length, at, sizes in found)
        waiting.clear()

    for row in spark.read.schema(TABLE).parquet(path).toLocalIterator():
        waiting.append(row)
        if len(waiting) == SHARD:
            flush()
    if waiting:
        flush()
    return json.dumps(sorted(index))


def language_column(index: str, text: str = "text"):
    """lang, score and match of a text column; `und` with 0 if nothing is learned."""

    @F.arrow_udf(RESULT)
    def language(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = _opened(index)
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("match", pa.float64())])
        for texts in parts:
            rows = texts.to_pylist()
            out = judge(parser, rows) if parser.names else [{"lang": "und", "score": 0.0, "match": 0.0}] * len(rows)
            yield pa.array(out, kind)

    return language.asNondeterministic()(F.col(text))


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, mean_match`` of every row of ``docs(doc_id, text, lang)``.

    A null text or one without letters is `und` with score 0. Any other text gets a learned language, also when it is in
    none of them; ``mean_match`` is then close to 1. Repeated rows give repeated results, an empty table none; other
    columns are ignored. A null id is not held out and never learned from.
    """
    ready(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("_l", language_column(learned(docs)))
    return rows.select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("_l.lang").alias("lang_pred"),
        F.col("_l.score").alias("score"),
        F.col("_l.match").alias("mean_match"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: those with letters whose phrases have ``LEAST_MATCH`` characters on average.

    If no language can be learned (no row of the teaching folds has a language and a text), there is nothing to judge by
    and every row stays. Columns stay as they were, a user's column of the helper's name included.
    """
    ready(spark)
    index = learned(docs)
    if not json.loads(index):
        return docs
    judged = fresh_name(docs, "_l")
    rows = docs.withColumn(judged, language_column(index))
    keep = (F.col(f"{judged}.lang") != "und") & (F.col(f"{judged}.match") >= LEAST_MATCH)
    return rows.filter(keep).select(*docs.columns)
