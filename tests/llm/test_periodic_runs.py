"""Periodic runs against an exhaustive search, the planted tails, and the edge cases of the contract."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from meterline.llm import periodic_runs as pr

SCHEMA = "doc_id long, text string, source string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(w):
    """Every stretch with its smallest period, kept when long enough and not extendable at either end."""
    n, out = len(w), []
    for i in range(n):
        for j in range(i + 1, n + 1):
            q = next(q for q in range(1, j - i + 1) if all(w[k] == w[k + q] for k in range(i, j - q)))
            if j - i >= max(12, 2 * q) and (i == 0 or w[i - 1] != w[i - 1 + q]) and (j == n or w[j] != w[j - q]):
                out.append((i, j - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_exhaustive_search():
    rnd = random.Random(7)
    for t in range(300):
        w = [rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 50))]
        if t % 2:
            p = rnd.randint(1, 9)
            base = [rnd.choice("abcd") for _ in range(p)]
            w = w[:8] + [base[i % p] for i in range(rnd.randint(0, 45))] + w[8:]
        assert pr.runs(w) == brute(w)


def test_long_and_degenerate_sequences_are_fast_and_whole():
    assert pr.runs(["x"] * 40000) == [(0, 40000, 1)]
    w = [str(i % 997) for i in range(30000)]
    assert pr.runs(w) == [(0, 30000, 997)]


def test_planted_tail_follows_the_contract():
    doc_id = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [f"w{i}" for i in range(200)]
    out = pr.planted(words, doc_id)
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % 200
    p = 1 + (200 - a) // (3 + g % 8)
    assert out[:a] == words[:a] and all(out[i] == words[a + (i - a) % p] for i in range(a, 200))
    assert pr.planted(words, doc_id + 1 if zlib.crc32(str(doc_id + 1).encode()) % 10 else doc_id + 2) == words
    assert pr.planted(words, None) == words and pr.planted([], doc_id) == []


def test_summary_digests_and_ties():
    w = ["a", "b"] * 10 + ["z"] + ["c", "d"] * 10
    s = pr.summary(w)
    assert s["n_runs"] == 2 and (s["start"], s["length"], s["period"]) == (0, 20, 2)  # tie: smallest start
    assert s["exponent_milli"] == 10000
    assert s["runs_sha256"] == hashlib.sha256(b"0,20,2\n21,20,2\n").hexdigest()
    assert s["collapsed_sha256"] == hashlib.sha256("a b z c d".encode()).hexdigest()
    none = pr.summary([])
    assert none["n_runs"] == 0 and none["start"] is None and none["runs_sha256"] == EMPTY and none["collapsed_sha256"] == EMPTY


def test_spark_rows_with_nulls_repeats_long_texts_and_clashing_columns(spark):
    long_text = " ".join(["lorem", "ipsum", "dolor"] * 5000)
    rows = [(1, "a b " * 10, "x"), (1, "a b " * 10, "x"), (None, "a b " * 10, None), (3, None, "y"), (4, "", "y"),
            (5, long_text, "z"), (6, "été\tété\n" * 7, "z")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_runs", F.lit("x"))
    out = sorted(pr.periodic_runs(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(out) == 7 and out[0] == out[1]
    for r in out:
        text = dict((d, t) for d, t, _ in rows).get(r.doc_id)
        expect = pr.summary(pr.planted(pr.words_of(text), r.doc_id))
        assert r.asDict() == {"doc_id": r.doc_id} | expect
    assert out[-1].doc_id is None and out[-1].n_runs == 1
    assert {r.doc_id: r.n_words for r in out}[3] == 0


def test_empty_table(spark):
    assert pr.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
