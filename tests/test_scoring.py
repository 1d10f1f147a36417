"""The score as Column functions: continuity, boundaries and the published worked examples."""

import pytest
from pyspark.sql import functions as F

from meterline.functions import scoring as S
from meterline.params import Params
from meterline.plans.spec_evals import worked_examples

P = Params()


def test_base_score_table(spark):
    table = {0.0: 0.40, 0.30: 0.40, 0.50: 0.70, 0.70: 1.0, 0.90: 1.0, 1.10: 1.0, 1.20: 1.10, 1.30: 1.20, 9.0: 1.20}
    df = spark.createDataFrame([(u,) for u in table], "u double").withColumn("s", S.base_score(F.col("u"), P))
    for row in df.collect():
        assert row.s == pytest.approx(table[row.u], abs=1e-9)


def test_base_score_trusts_missing_signal(spark):
    df = spark.createDataFrame([(None,)], "u double")
    assert df.select(S.base_score(F.col("u"), P)).first()[0] == 1.0


def test_worked_examples(spark):
    rows = worked_examples(spark, P).collect()
    assert len(rows) == 6
    assert all(r.passed for r in rows), rows


CASES = [
    # hs, m1, age, n, u, band
    (0.55, None, 10, 1, 0.4, "at_risk_shelfware"),
    (0.5500001, None, 10, 1, 0.4, "healthy"),
    (0.60, 0.70, 90, 1, 1.3, "spike_drop"),
    (0.60, 0.6999, 90, 1, 1.3, "overage"),
    (0.60, 0.70, 89, 1, 1.3, "overage"),
    (0.50, 0.90, 90, 2, 1.3, "at_risk_shelfware"),
    (0.60, 0.90, 90, 2, 1.3, "spike_drop"),
    (1.10, 0.10, 90, 2, 1.01, "expansion"),
    (1.00, 0.10, 90, 2, 1.0, "healthy"),
    (1.00, 0.10, 90, 1, 1.10, "healthy"),
    (1.00, 0.10, 90, 1, 1.1001, "overage"),
    (1.00, None, 90, 1, None, "healthy"),
]


def test_band_first_match_wins(spark):
    df = spark.createDataFrame(CASES, "hs double, m1 double, age bigint, n bigint, u double, want string")
    got = df.withColumn("got", S.band(F.col("hs"), F.col("m1"), F.col("age"), F.col("n"), F.col("u"), P)).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_spike_wins_over_expansion(spark):
    df = spark.createDataFrame([(0.70, 90, 2, 1.5)], "m1 double, age bigint, n bigint, u double")
    mod = S.modifier(
        S.is_spike(F.col("m1"), F.col("age"), P), S.is_expanding(F.col("n"), F.col("u"), P), P
    )
    assert df.select(mod).first()[0] == 0.50


def test_clamp(spark):
    df = spark.createDataFrame([(1.2, 1.1), (0.4, 0.5)], "b double, m double")
    assert [r[0] for r in df.select(S.healthscore(F.col("b"), F.col("m"), P)).collect()] == [1.30, 0.40]


def test_narrative_without_score(spark):
    df = spark.createDataFrame(
        [(None, "healthy", None, None, 1, 1.0, 1.0, 1.0)],
        "healthscore double, band string, utilization_u double, m1_share double, n_active_contracts bigint,"
        " modifier double, carr double, committed_arr double",
    )
    assert df.select(S.narrative(P)).first()[0] == "No active contract on the snapshot date; metric not computed."


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.40,), (1.30,), (0.85,)], "x double")
    bins = df.select(S.histogram_bin(F.col("x"), F.lit(0.40), F.lit(1.30), 20)).collect()
    assert [b[0] for b in bins][:2] == [0, 19]


def test_texts_round_the_exact_value(spark):
    values = [0.625, 0.295, 0.125, 0.135, 0.5, 1.005, 1.3, 0.4, 0.8750000000000001, 0.875, 2.675, 7.995]
    shares = [0.125, 0.135, 0.375, 0.005, 0.015, 2.5, 0.145]
    money = [0.5, 1.5, 2.5, 1234567.5, 1234568.5, 999.49999999, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.two_decimals(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == {v: f"{v:.2f}" for v in values}
    df = spark.createDataFrame([(v,) for v in shares], "v double").select("v", S.percent_text(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == {v: f"{v:.0%}" for v in shares}
    df = spark.createDataFrame([(v,) for v in money], "v double").select("v", S.dollars_text(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == {v: f"${v:,.0f}" for v in money}
    literal = {0.625: "0.62", 0.295: "0.29"}
    assert {v: f"{v:.2f}" for v in literal} == literal and f"{0.125:.0%}" == "12%"
