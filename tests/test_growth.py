"""What keeps the costs of large runs in proportion: no broadcast of repeated rows, one roll-up, work per stretch and not per day."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from meterline.functions.edges import publish, publish_early
from meterline.operators.skew import salted_join
from meterline.operators import intervals as I
from meterline.operators import usage as U
from meterline.plans import book, build, evals, history, spec_evals, variants
from meterline.sources import sinks

T = date(2026, 4, 18)
CONTRACTS = [("C1", "A1", date(2025, 1, 1), date(2026, 12, 31), "1200.00", 100), ("C2", "A1", date(2026, 3, 1), date(2026, 6, 30), "99.99", 7)]
USAGE = [("L1", "A1", date(2026, 3, 5), "50.25"), ("L2", "A1", date(2026, 4, 1), "300.00"), ("L3", "A9", date(2026, 4, 2), "1.00"),
         ("L4", "A1", date(2024, 4, 2), "5.00"), ("L5", None, date(2026, 4, 2), "2.00")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_dimension_are_not_broadcast(spark):
    fact = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, id long")
    dim = spark.createDataFrame([("a", "x")], "k string, v string")
    for how in ("left", "inner", "left_anti"):
        assert "Broadcast" not in plan(salted_join(fact, dim, ["k"], ["id"], 8, how))


def test_unfolded_months_are_not_joined(make_book):
    b = make_book(CONTRACTS, USAGE)
    audit = variants.overage_month_audit(b)
    assert not [x for x in plan(audit).splitlines() if "Join" in x and "month" in x]
    row = audit.first()
    assert (row.account_id, row.n_months, row.min_ratio, row.n_over) == ("A1", 2, pytest.approx(0.5025), 1)


def test_reports_of_several_dates_share_one_rollup(make_book):
    b = make_book(CONTRACTS, USAGE)
    assert evals.eval_report_delta_run(b).count() == 16
    assert b.at(b.p.prior_as_of).usage_rollup is b.rolled.usage_rollup is b.settled.usage_rollup
    # the ids of the logs are counted for the checks that ask for them only
    assert not {"log_facts", "log_ids"} & set(b.__dict__)
    assert b.settled.log_facts is b.log_facts and b.settled.log_ids.first().n_ids == 5


def test_active_days_need_no_usage(make_book):
    b = make_book(CONTRACTS, USAGE)
    days = history.active_days(b, date(2026, 2, 27), date(2026, 3, 2))
    assert not {"valid_daily", "usage_rollup"} & set(b.__dict__)
    got = [(r.day, r.committed_arr_on_day, r.active_contract_count) for r in days.orderBy("day").collect()]
    assert got == [(date(2026, 2, 27), 1200.0, 1), (date(2026, 2, 28), 1200.0, 1), (date(2026, 3, 1), 1299.99, 2), (date(2026, 3, 2), 1299.99, 2)]


def test_age_turns_inside_a_stretch(make_book):
    """All use lies in the first month of the window; from an age of ``spike_min_age`` on it counts as a spike."""
    start = T - timedelta(days=100)
    b = make_book([("C1", "A1", start, T + timedelta(days=300), "1000.00", 10)], [("L1", "A1", start + timedelta(days=5), "30.00")])
    rows = history.metric_on(b, history.every_day(T - timedelta(days=40), T)).collect()
    assert {r.as_of_date: r.contract_age_days for r in rows} == {r.as_of_date: (r.as_of_date - start).days for r in rows}
    spike = {r.as_of_date for r in rows if r.m1_share is not None and r.m1_share >= b.p.spike_m1_share and r.contract_age_days >= b.p.spike_min_age}
    assert spike and {r.as_of_date for r in rows if r.healthscore == pytest.approx(0.5)} == spike and len(rows) == 41


def test_columns_are_published_before_rows_unfold(spark, make_book):
    df = spark.sql("select cast(1.23456 as decimal(9,5)) as arr, 0.1234567D as ratio, array(1, 2) as xs")
    early = publish_early(df, ["arr", "ratio"]).withColumn("x", F.explode("xs")).drop("xs")
    late = df.withColumn("x", F.explode("xs")).drop("xs")
    assert publish(early).collect() == publish(late).collect() and publish(early).schema == publish(late).schema
    lines = plan(publish(variants.contract_day(make_book(CONTRACTS, USAGE)))).splitlines()
    assert next(i for i, x in enumerate(lines) if "Generate" in x) < next(i for i, x in enumerate(lines) if "round(" in x)


def test_rows_of_closed_months_are_not_worked_out_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(date(2026, 1, 31), "A", 1.0)], "month_end date, account_id string, carr double")
    sinks.publish_months(df, str(tmp_path / "m"))
    monkeypatch.setattr(sinks, "month_digest", lambda *_: pytest.fail("a refused month was written"))
    assert sinks.publish_months(df, str(tmp_path / "m")) == [date(2026, 1, 31)]


def test_contract_without_amount_counts_as_zero(make_book):
    b = make_book(CONTRACTS, USAGE)
    b.stg_contracts = b.stg_contracts.withColumn("annual_commit_dollars", F.lit(None).cast("decimal(18,2)"))
    got = history.active_days(b, T, T).first()
    assert (got.committed_arr_on_day, got.active_contract_count) == (0.0, 2)


def test_logs_of_a_snapshot_are_classified_once(spark, make_book, tmp_path, monkeypatch):
    """The daily roll-up is summed from the classified logs, and the id index is written without a shuffle."""
    usage = [*USAGE, ("L6", "A1", date(2026, 4, 1), "0.25"), ("L7", None, date(2026, 4, 2), "3.00")]
    b = make_book(CONTRACTS, usage)
    want = b.usage_daily.collect()
    monkeypatch.setattr(U, "classify_daily", lambda *_: pytest.fail("the logs are classified again"))
    stored = build.write_all(spark, b.sources, str(tmp_path), b.p)
    assert sorted(map(str, stored.usage_daily.select(*b.usage_daily.columns).collect())) == sorted(map(str, want))
    assert stored.usage_daily.schema["credits_consumed"].dataType == b.usage_daily.schema["credits_consumed"].dataType
    hinted = []
    monkeypatch.setattr(DataFrame, "hint", lambda self, name, *a, f=DataFrame.hint: hinted.append(name) or f(self, name, *a))
    sinks.write_index(spark.read.parquet(str(tmp_path / "stg_daily_usage_logs")), str(tmp_path / "other"))
    assert not hinted
    rows = sinks.read_index(spark, str(tmp_path / "other")).collect()
    logs = b.stg_daily_usage_logs.select(F.xxhash64("log_id"), F.trunc("usage_date", "month")).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, map(tuple, logs)))


def many_contracts(k=60):
    """Contracts that overlap, repeat dates, leave gaps, end before they start, lack an amount, or belong to no account."""
    day = lambda i: T - timedelta(days=i)
    terms = (0, 20, 90, 400, -3)
    return [(f"C{i}", ("A1", "A2", "A9")[i % 7 % 3], day(37 * i % 900), day(37 * i % 900 - terms[i % 5]), "10.50", 5 + i % 3) for i in range(k)] + [
        ("D1", "A2", day(30), day(-10), "1.25", 1), ("D2", "A2", day(30), day(-10), "2.25", 2), ("D3", "A2", day(30), day(-40), "3.00", 0)]


def test_stretches_of_summed_contracts(make_book):
    b = make_book(many_contracts())
    contracts = b.stg_contracts
    want = I.active_stretches(contracts).select("account_id", "oldest_active_start", "from_day", "to_day")
    got = I.with_stretch(I.totals_by_dates(contracts)).where("from_day is not null").select("account_id", "start_date", "from_day", "end_date")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_usage_is_shuffled_once_for_the_changes(spark, make_book):
    """The days of usage that were dealt out by account to look up their contracts aren't dealt out again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(history._changes(make_book(CONTRACTS, USAGE), None, T).groupBy("account_id").count()).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(lines) if "Join" in x and "usage_date" in x)
    above, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            above, level = [*above, x], depth(x)
    assert [x for x in above if "Union" in x] and not [x for x in above if "Exchange" in x]


def test_score_is_worked_out_after_the_months_are_gathered(make_book):
    b = make_book(many_contracts(), USAGE, accounts=(("A1", "Acme", "BUILDING", "R1"), ("A2", "Bolt", "BUILDING", "R2")))
    rows = history.metric_on(b, history.every_month_end(T), gathered=True)
    lines = plan(rows).splitlines()
    gathered = next(i for i, x in enumerate(lines) if "REBALANCE" in x)
    assert next(i for i, x in enumerate(lines) if "healthscore" in x) < gathered
    assert not [x for x in lines[gathered:] if "healthscore" in x or "utilization_u" in x]
    want = b.all_month_ends
    assert rows.schema == want.schema
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) and rows.count() > 40


def test_recomputed_months_stay_where_they_are(make_book):
    """Closed months are compared without a shuffle by month of the recomputed rows, whose accounts are dealt out already."""
    b = make_book(many_contracts(), USAGE, accounts=(("A1", "Acme", "BUILDING", "R1"), ("A2", "Bolt", "BUILDING", "R2")))
    freeze = spec_evals.eval_freeze(b)
    assert "Exchange hashpartitioning(month_end" not in plan(freeze) and "Exchange hashpartitioning(as_of_date" not in plan(freeze)
    row = freeze.first()
    months = history.carr_account_month_end(b.at(b.p.month_ends[-2])).count()
    assert (row.n_rows, row.n_changed, row.identical) == (months, 0, True) and months > 40


def test_compare_counts_the_rows_of_a_full_join(spark, make_book):
    """Repeated keys count every pair, rows without a partner differ unless they have no value."""
    b = make_book(CONTRACTS)
    schema = "month_end date, account_id string, carr double"
    m = [date(2026, i, 28) for i in (1, 2, 3)]
    old = [(m[0], "A", 1.0), (m[0], "B", None), (m[1], "A", 2.0), (m[1], "A", 2.0), (m[1], "A", 3.0), (m[1], "C", 0.0), (m[2], "D", None), (m[2], "E", 5.0)]
    new = [(m[0], "A", 1.0), (m[0], "B", None), (m[1], "A", 2.0), (m[1], "A", None), (m[1], "C", -0.0), (m[1], "F", None), (m[2], "G", 7.0), (m[2], "H", float("nan"))]
    old, new = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    both = old.withColumnRenamed("carr", "old").join(new.withColumnRenamed("carr", "new"), ["month_end", "account_id"], "full_outer")
    want = both.agg(F.count("*"), F.count_if(~F.col("old").eqNullSafe(F.col("new")))).first()
    assert tuple(history.compare(b, old, new).first()) == tuple(want) == (14, 7)
    assert tuple(history.compare(b, old.where("false"), new.where("false")).first()) == (0, 0)


def test_large_rollups_are_dealt_to_more_tasks(make_book, monkeypatch):
    monkeypatch.setattr(book, "ROLLUP_ROWS", 10)
    usage = [(f"L{i}", "A1", T - timedelta(days=i), "1.00") for i in range(115)]
    b = make_book(CONTRACTS, usage)
    assert b.account_tasks == 8
    later = b.at(T)
    assert later.account_tasks == 12
    text = plan(later.all_month_ends)
    assert "hashpartitioning(account_id" in text
    assert later.valid_daily.rdd.getNumPartitions() == 12
    assert sorted(map(str, later.all_month_ends.collect())) == sorted(map(str, b.all_month_ends.collect()))
