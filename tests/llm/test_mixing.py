"""Mixing against a plain water-filling loop and a plain sort."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterline.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def filled(sizes: dict, shares=(5, 2, 1), volume=1.5, most=2) -> dict:
    """Targets by resharing the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: shares[i % len(shares)] for i, s in enumerate(order)}
    left, open_, target = volume * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def quality(text):
    if not text:
        return 0.05
    plain = sum(c.isalpha() or c.isdigit() or c.isspace() for c in text)
    return max(0.05, (plain / len(text)) ** 4)


def expected(rows):
    size = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    sources = {s for _, _, s in rows}
    totals = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    target, out = filled(totals), {}
    for s in sources:
        budget = target[s] - (epochs := int(target[s] // totals[s]) if totals[s] else 0) * totals[s]

        def key(i):
            head = int(hashlib.md5(str(rows[i][0]).encode()).hexdigest()[:12], 16)
            return -math.log((head + 0.5) / (1 << 48)) / quality(rows[i][1])

        run = 0
        for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=key):
            run += size[i]
            out[rows[i][0]] = (size[i], totals[s], round(target[s], 6), size[i] * (epochs + (run - size[i] / 2 <= budget and budget > 0)))
    return out


def rows_of(n, sources):
    return [(i, " ".join(["word"] * (1 + i * 7 % 23)) + "%" * (i % 5), sources[i % len(sources)]) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"], ["a", "b", "c"], ["a"] * 8 + ["b", None, "c", "d"], ["z", "é", "\U0001F600", "�", "a"]])
def test_plan(spark, sources):
    rows = rows_of(240, sources)
    got = mixing.plan_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r["size"], r.source_size, round(r.target, 6), r.taken) for r in got} == expected(rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 24
        assert all(r.taken <= 2 * r["size"] and r.taken >= 0 for r in own)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", None), (4, "v", "b"), (5, None, "empty")]
    got = mixing.plan_mix(spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA + ", size int, target int")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.source_size for r in got if r.source == "empty"} == {5: 0}
    assert all(r.taken == 0 and r.copies == 0 for r in got if r.source == "empty")
    assert mixing.plan_mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_mix_repeats_documents(spark):
    docs = spark.createDataFrame(rows_of(60, ["a", "b", "c"]), SCHEMA)
    counts = {r[0]: r[1] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in mixing.plan_mix(docs).collect() if r.copies}
    assert mixing.mix(docs).columns == docs.columns
    assert max(counts.values()) == 2


def test_mix_takes_each_row_for_itself(spark):
    rows = rows_of(60, ["a", "b"])
    rows += [rows[4]] * 3 + [(rows[6][0], "other text of that id", "a")] * 2 + [(None, f"no id {i}", "a") for i in range(25)] + [(None, "no id 0", "b")] * 20
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", size int, target int, copies int")
    for settings in ({}, {"volume": 0.5}, {"volume": 2.0}):
        plan = mixing.plan_mix(docs, **settings).collect()
        out = mixing.mix(docs, **settings)
        assert out.columns == docs.columns
        got, want = Counter(), Counter()
        for r in out.collect():
            got[r.doc_id, r.source, len(WORDS.findall(r.text))] += 1
        for r in plan:
            want[r.doc_id, r.source, r["size"]] += r.copies
        assert got == +want
        assert not set(map(tuple, out.collect())) - {(*r, 1, 2, 3) for r in rows}
        most, taken = Counter(rows), Counter((r.doc_id, r.text, r.source) for r in out.collect())
        assert all(n <= 2 * most[r] for r, n in taken.items())
        for s in "ab":
            words = sum(n * len(WORDS.findall(r[1])) for r, n in taken.items() if r[2] == s)
            assert abs(words - next(r.target for r in plan if r.source == s)) <= 24


def test_heavier_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "w", "a") for i in range(2000)], SCHEMA)
    plan = mixing.plan_mix(docs, weight=F.when(F.col("doc_id") < 1000, 9.0).otherwise(1.0), volume=0.25)
    taken = [r.doc_id for r in plan.filter("copies = 1").collect()]
    assert len(taken) == 500 and sum(i < 1000 for i in taken) > 400
