"""Fingerprints against a plain Python version of every step."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from meterline.llm import fingerprint as fp

SCHEMA = "doc_id long, text string"


def h(value, seed=42):
    raw = value.encode() if isinstance(value, str) else (value & (2**64 - 1)).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed=seed)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chained(values):
    seed = 42
    for v in values:
        seed = h(v, seed)
    return seed


def int_hash(i, seed):
    return xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=seed)


def plain(text: str | None) -> list[int]:
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return []
    hashes = [h(w) for w in words]
    sets = [chained(hashes[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [chained(hashes)]
    bins = [None] * fp.BINS
    for x in map(signed, sets):
        b = (x >> 56) + 128
        if x & (2**56 - 1) != 2**56 - 1 and (bins[b] is None or x < bins[b]):
            bins[b] = x
    order = list(zip(*fp._probes()))
    full = []
    for i, x in enumerate(bins):
        if x is None:
            x = next((bins[b] for b in order[i] if bins[b] is not None), None)
        if x is None:
            x = min((signed(int_hash(j, int_hash(i, 42))), v) for j, v in enumerate(bins) if v is not None)[1]
        full.append(x)
    return full


def packed(full):
    return "".join(f"{v & 15:x}" for v in full)


def test_same_as_plain(spark):
    rnd = random.Random(8)
    texts = [
        " ".join(rnd.choice(["Alpha", "beta", "γ", "d", "e%"]) + str(rnd.randint(0, 9)) for _ in range(n))
        for n in (1, 3, 5, 6, 9, 40, 150, 300, 700, 1500)
    ] + ["ONE \n", "one", " ", None]
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == {i: packed(plain(t)) for i, t in enumerate(texts)}


def jaccard(x, y):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_likeness_is_unbiased(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        words = [str(rnd.random()) for _ in range(400)]
        cut = rnd.randint(0, 400)
        rows.append((i, " ".join(words), " ".join(words[:cut] + [str(rnd.random()) for _ in range(400 - cut)])))
    df = spark.createDataFrame(rows, "doc_id long, x string, y string")
    got = df.select("doc_id", fp.likeness(fp.packed(F.col("x")), fp.packed(F.col("y"))).alias("near")).collect()
    off = [r.near - jaccard(*rows[r.doc_id][1:]) for r in got]
    assert abs(sum(off) / len(off)) < 0.015 and max(map(abs, off)) < 0.15


def test_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 3)
    rnd = random.Random(10)
    rows = [(i * 7 % 101, "".join(rnd.choice("aé漢😀 ") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    got = {r.doc_id: r for r in fp.edited(spark.createDataFrame(rows, SCHEMA)).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(t) // 4
        want = t[: len(t) - n] + after[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_odd_tables(spark):
    one = fp.edited(spark.createDataFrame([(5, "a b c d e f")], SCHEMA)).collect()
    assert one[0].near_next == 1.0
    assert fp.edited(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = fp.edited(spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c"), (6, "")], SCHEMA)).collect()
    assert len(twice) == 4 and {r.fingerprint for r in twice if r.doc_id == 6} == {""}
    clash = spark.createDataFrame([(1, "x", "y", 3)], SCHEMA + ", fingerprint string, code int")
    assert fp.fingerprints(clash).columns == ["doc_id", "fingerprint"]
    assert fp.fingerprints(spark.createDataFrame([(1, "wo rd " * 100_000)], SCHEMA)).count() == 1


def test_plan_is_native(spark):
    plan = fp.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
