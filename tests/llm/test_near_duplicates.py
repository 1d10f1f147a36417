"""Near-duplicate groups against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import near_duplicates as nd

SCHEMA = "doc_id long, text string"


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        own = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
        out[i] = own
    return out


def brute(rows, k, percent=80):
    sets = sets_of(rows, k)
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, groups, copies, length):
    """Chains of edited copies around the threshold, exact copies, short texts and a passage that many documents share."""
    rnd = random.Random(seed)
    common = " ".join(f"c{rnd.randint(0, 50)}" for _ in range(30))
    texts = []
    for _ in range(groups):
        words = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(3, length))]
        for _ in range(rnd.randint(1, copies)):
            new = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 18))):
                new[rnd.randrange(len(new))] = f"x{rnd.randint(0, 10**6)}"
            texts.append(" ".join(new).upper() if rnd.random() < 0.2 else " ".join(new))
            words = new if rnd.random() < 0.6 else words
    texts += [common + " " + " ".join(f"y{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(5, 60))) for _ in range(60)]
    texts += ["", " \n", "one", "One", "one two", "a b c d e", "a b c d e f", "a b c d", "z a b c d e"]
    rnd.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(2, None)]


@pytest.mark.parametrize(("k", "small"), [(2, False), (2, True), (5, True)])
def test_same_as_all_pairs(spark, monkeypatch, k, small):
    if small:  # many chunks, many pieces of work
        for name, value in (("CHUNK", 7), ("CHUNK_SHINGLES", 400), ("ROWS_AT_ONCE", 50), ("MATCHES_AT_ONCE", 500), ("SENT_IDS", 10)):
            monkeypatch.setattr(nd, name, value)
    rows = corpus(k, 45, 9, 160)
    got = nd.groups(spark.createDataFrame(rows, SCHEMA), words=k).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, k)


def test_every_link_of_small_sets(spark):
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.sample("abcdefgh", rnd.randint(1, 7)))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"v{j}" for j in range(n) if j != drop)) for i, (n, drop) in enumerate((n, d) for n in range(4, 14) for d in (-1, 0, n // 2, n - 1))]
    got = nd.groups(spark.createDataFrame(rows, SCHEMA), words=1).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, 1)


def test_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 50)
    rnd = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(120)] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    got = nd.groups(spark.createDataFrame(rows, SCHEMA), words=2).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, 2)


def test_odd_rows(spark):
    rows = [(5, "a b c"), (5, "a b c"), (6, "A b  c"), (None, "a b c"), (7, None), (8, ""), (9, "long text " * 50_000)]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA + ", component_id int, kept boolean")
    got = [tuple(r) for r in nd.groups(df, words=2).collect()]
    assert sorted(got, key=str) == sorted(
        [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (None, 2, None, True), (7, 0, 7, True), (8, 0, 8, True), (9, 2, 9, True)], key=str
    )
    stage = nd.stage(spark, df, "")
    # one row of the group of 5, 5, 6 and the null id stays (the first of id 5); rows without words stay
    assert stage.columns == df.columns and sorted(r.doc_id or 0 for r in stage.collect()) == [5, 7, 8, 9]
    assert nd.groups(df.filter("false")).collect() == []
    with pytest.raises(ValueError):
        nd.groups(df, percent=70)


def test_shared_counts_and_estimates(monkeypatch):
    monkeypatch.setattr(nd, "MATCHES_AT_ONCE", 40)
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 80)).astype(np.uint64)) for _ in range(30)]
    sketches = [s[: nd.K] for s in sets]
    seen = 0
    for at, shared in nd.shared_counts(sketches[:12], sketches):
        guess = nd.estimates(shared, sketches[at : at + len(shared)], sketches)
        for i in range(len(shared)):
            for j in range(30):
                assert shared[i, j] == len(np.intersect1d(sketches[at + i], sketches[j]))
                assert guess[i, j] == pytest.approx(nd.union_estimate(sketches[at + i], sketches[j]))
                seen += 1
    assert seen == 12 * 30


def test_stage_leaves_one_of_repeated_rows_and_null_ids(spark):
    from meterline.llm import near_duplicates as nd

    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (None, text, "b"), (None, other, "c"), (None, other, "c"),
            (7, None, "d"), (8, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    out = nd.stage(spark, docs, "")
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    assert out.columns == docs.columns
    assert [(r.doc_id, r.text) for r in got] == [(1, text), (7, None), (8, ""), (None, other)]
    assert got[0]._row == "a"


def test_members_meet_their_block_once(spark):
    """Both sides of the pieces of work come from one join, and every minor meets every other member of its block in one piece."""
    rnd = random.Random(15)
    sizes = {1: 40, 2: 3, 3: 1, 4: 25}
    rows = [(b, 100 * b + i, rnd.randint(1, 9), i % 3 == 0) for b, n in sizes.items() for i in range(n)]
    rows += [(5, 500 + i, 2, False) for i in range(4)]
    members = spark.createDataFrame(rows, "block long, rep long, n long, minor boolean")
    out = nd.dealt(members, F.col("n"), 20, 60)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    left, right, jobs = {}, {}, {}
    for r in out.collect():
        ({0: left, 1: right}[r.side]).setdefault((r.block, r.lc, r.rc), []).append(r.rep)
        jobs.setdefault((r.block, r.lc, r.rc), set()).add(r.job)
    met = sorted((x, y) for k, xs in left.items() for x in xs for y in right.get(k, []))
    assert met == sorted((x[1], y[1]) for x in rows if x[3] for y in rows if x[0] == y[0])
    assert all(len(j) == 1 for j in jobs.values()) and len({j for js in jobs.values() for j in js}) > 2
