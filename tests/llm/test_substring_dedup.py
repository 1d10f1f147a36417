"""Substring dedup against a plain loop over all windows, with the edge cases of the contract."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meterline.llm import substring_dedup as sd
from meterline.llm.common import table

SCHEMA = "doc_id long, text string, tag string"


def plain(rows):
    """doc_id -> (n_words, n_removed, kept_sha256) by a dictionary of first places: nulls after every id, rows of one
    id with different texts by the SHA-256 of the text."""
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    key = lambda d, t: (d is None, d or 0, sha(t))
    first = {}
    for d, text in rows:
        w = sd.words_of(text)
        for s in range(len(w) - 19):
            seq = tuple(w[s : s + 20])
            first[seq] = min(first.get(seq, (key(d, text), s)), (key(d, text), s))
    out = []
    for d, text in rows:
        w = sd.words_of(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (key(d, text), s):
                gone[s : s + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).withColumn("n_removed", F.lit("x"))
    got = sd.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, tuple(r[1:]))
    return sorted([tuple(r) for r in got], key=key)


def test_against_plain_loop_on_random_passages(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    shared = [rnd.choice(vocab) for _ in range(45)]
    rows = []
    for d in range(40):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 90))]
        if d % 3 == 0:
            at = rnd.randint(0, len(w))
            w[at:at] = shared[rnd.randint(0, 10) : rnd.randint(25, 45)]
        if d % 7 == 0:
            w = w + w  # a repeat inside one document
        rows.append((rnd.choice([d, d, None]) if d % 11 == 0 else d, " ".join(w)))
    assert run(spark, rows) == plain(rows)


def test_edge_cases(spark):
    twenty = " ".join(f"t{i}" for i in range(20))
    long_text = " ".join(f"x{i % 5000}" for i in range(60000))
    rows = [(1, twenty), (1, twenty), (2, twenty), (3, None), (4, ""), (5, "a b c"), (None, twenty), (None, twenty),
            (6, long_text), (7, "é " + twenty.replace(" ", "\t"))]
    got = run(spark, rows)
    assert got == plain(rows)
    by_id = {r[0]: r for r in got}
    assert by_id[1][2] == 0 and by_id[2][2] == 20 and by_id[None][2] == 20
    assert by_id[3][1:3] == (0, 0) and by_id[7][2] == 20
    assert by_id[6][2] == 60000 - 5000  # the second half repeats the first


def test_one_id_with_two_texts_orders_by_text_hash(spark):
    a = " ".join(f"p{i}" for i in range(25))
    b = "x y " + a
    rows = [(9, a), (9, b), (None, "q " + a), (None, "r " + a)]
    got = run(spark, rows)
    assert got == plain(rows)
    first = min((a, b), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert {r[1]: r[2] for r in got if r[0] == 9} == {len(first.split()): 0, len((a if first == b else b).split()): 25}


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_plain_loop(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in sd.query(spark, sf_dir).collect())
    assert got == sorted(plain([(r.doc_id, r.text) for r in docs]))
