"""Intervals, order statistics and salted joins against brute force in plain Python."""

import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from meterline.operators import intervals as I
from meterline.operators import ordered as O
from meterline.operators.skew import salted_join
from meterline.operators.usage import reconcile

DAY0 = date(2025, 1, 1)


def random_contracts(seed, n=400, accounts=5):
    """A third of all contracts belong to one account, many share a start day."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = "HOT" if rnd.random() < 0.34 else f"A{rnd.randrange(accounts)}"
        s = DAY0 + timedelta(days=rnd.randrange(60))
        out.append((f"C{i:04d}", a, s, s + timedelta(days=rnd.randrange(0, 90)), rnd.randrange(1, 50)))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(
        rows, "contract_id string, account_id string, start_date date, end_date date, included_monthly_credits bigint"
    )
    return df.withColumn("annual_commit_dollars", (F.col("included_monthly_credits") * 10).cast("decimal(18,2)"))


def per_account(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


def test_previous_contract(spark):
    rows = random_contracts(1)
    want = {}
    for g in per_account(rows).values():
        for prev, cur in zip([None, *g], g):
            want[cur[0]] = prev[0] if prev else None
    # More slices than accounts, so the hot account, and even one of its start days, spans several of them.
    for slices in (1, 40):
        got = O.with_previous(
            frame(spark, rows), ["account_id"], ["start_date", "contract_id"], ["contract_id"], "prev", slices
        ).select("contract_id", F.col("prev.contract_id").alias("p"))
        assert {r.contract_id: r.p for r in got.collect()} == want


def test_overlap_counts(spark):
    rows = random_contracts(2)
    want = {a: sum(x[3] > y[2] for x, y in zip(g, g[1:])) for a, g in per_account(rows).items()}
    got = {r.account_id: r.n_overlapping_pairs for r in I.overlap_counts(frame(spark, rows)).collect()}
    assert got == want


def test_stretches_give_the_oldest_active_start(spark):
    rows = random_contracts(3, n=60)
    want = {}
    for a, g in per_account(rows).items():
        for k in range(160):
            d = DAY0 + timedelta(days=k)
            starts = [r[2] for r in g if r[2] <= d <= r[3]]
            if starts:
                want[a, d] = min(starts)
    got = {}
    for r in I.active_stretches(frame(spark, rows)).collect():
        d = r.from_day
        while d <= r.to_day:
            assert (r.account_id, d) not in got
            got[r.account_id, d] = r.oldest_active_start
            d += timedelta(days=1)
    assert got == want


def test_max_concurrency_and_primary(spark):
    rows = random_contracts(4, n=80)
    low, high = DAY0 + timedelta(days=20), DAY0 + timedelta(days=70)
    conc, best = {}, {}
    for a, g in per_account(rows).items():
        for k in range((high - low).days + 1):
            d = low + timedelta(days=k)
            on = [r for r in g if r[2] <= d <= r[3]]
            if on:
                conc[a] = max(conc.get(a, 0), len(on))
                best[a, d] = min(on, key=lambda r: (-r[4], r[0]))[0]
    df = frame(spark, rows)
    assert {r.account_id: r.max_active for r in I.max_concurrency(df, low, high).collect()} == conc
    got = {(r.account_id, r.day): r.contract_id for r in I.primary_contract_days(df, low, high).collect()}
    assert got == best


def test_percentiles_match_numpy_with_hot_values(spark):
    rnd = random.Random(5)
    rows = [("x", 1.0 if rnd.random() < 0.4 else round(rnd.uniform(0, 5), 2)) for _ in range(997)]
    rows += [("y", float(k)) for k in range(10)] + [("z", 3.0)] + [("x", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    for slices in (1, 7):
        got = {r.g: r for r in O.percentiles(df, ["g"], "v", probs, slices).collect()}
        for g in "xyz":
            vals = [v for k, v in rows if k == g and v is not None]
            for n, q in probs.items():
                assert abs(got[g][n] - np.quantile(vals, q)) < 1e-9, (g, n)


def test_ranks_match_brute_force(spark):
    rnd = random.Random(6)
    vals = [7 if rnd.random() < 0.34 else rnd.randrange(50) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "v bigint")
    for desc in (False, True):
        got = {r.v: r for r in O.ranked_values(df, [], "v", 6, descending=desc).collect()}
        for v in set(vals):
            smaller = sum((x > v) if desc else (x < v) for x in vals)
            same = vals.count(v)
            assert (got[v]["rank"], got[v].avg_rank, got[v].n_all) == (smaller + 1, smaller + (same + 1) / 2, len(vals))


def test_salted_join_keeps_every_row(spark):
    fact = spark.range(3000).select(
        F.col("id").cast("string").alias("log_id"),
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, "HOT").otherwise(
            F.concat(F.lit("K"), (F.col("id") % 7).cast("string"))
        ).alias("k"),
    )
    dim = spark.createDataFrame([("HOT", 1), ("K1", 2), ("K2", 3)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = fact.join(dim, "k", how)
        salted = salted_join(fact, dim, ["k"], ["log_id"], 8, how)
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.select(*plain.columns).collect()))


def test_reconcile_counts_replays_once(spark):
    rows = [("a", "A", DAY0, 5), ("a", "A", DAY0, 5), ("b", "A", DAY0, 7), ("c", "A", DAY0 + timedelta(days=1), 1),
            ("c", "A", DAY0, 9)]
    df = spark.createDataFrame(rows, "log_id string, account_id string, usage_date date, c int").select(
        "log_id", "account_id", "usage_date", F.col("c").cast("decimal(18,2)").alias("credits_consumed")
    )
    got = {r.usage_date: (r.n_logs, int(r.credits_consumed)) for r in reconcile(df).collect()}
    assert got == {DAY0: (2, 12), DAY0 + timedelta(days=1): (1, 1)}
