"""Boundaries of the thirteen tables on hand-made rows."""

from datetime import date, timedelta
from decimal import Decimal

from meterline.operators import intervals
from meterline.plans import history, marts, quality, variants
from pyspark.sql import functions as F

T = date(2026, 4, 18)
D = timedelta


def contract(i, account="A1", start=T - D(200), end=T + D(100), arr=1000, included=100):
    return (i, account, start, end, arr, included)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_window_bounds(make_book):
    days = {"out": T - D(90), "first": T - D(89), "m1": T - D(60), "after_m1": T - D(59), "last": T, "future": T + D(1)}
    usage = [(n, "A1", d, 10 ** i) for i, (n, d) in enumerate(days.items())]
    row = make_book([contract("C1")], usage).int_usage_rolled.first()
    assert row.credits_90d == Decimal("11110.00")
    assert row.credits_month_1 == Decimal("110.00")
    assert row.expected_credits_90d == 300


def test_usage_classes(make_book):
    b = make_book(
        [
            contract("C1", start=T - D(300), end=T - D(200)),
            contract("C2", start=T - D(100), end=T),
            contract("C3", account="GHOST"),
        ],
        [
            ("start", "A1", T - D(300), 1),
            ("end", "A1", T, 1),
            ("gap", "A1", T - D(150), 1),
            ("before", "A1", T - D(301), 1),
            ("after", "A1", T + D(1), 1),
            ("unknown", "ZZ", T, 1),
            ("ghost", "GHOST", T, 1),
            ("missing", None, T, 1),
            ("bare", "A2", T, 1),
        ],
        accounts=[("A1", "a", "BUILDING", "R1"), ("A2", "b", "BUILDING", "R1")],
    )
    want = {
        "start": "valid", "end": "valid", "gap": "valid", "before": "orphan_out_of_window",
        "after": "orphan_out_of_window", "unknown": "orphan_bad_account", "ghost": "orphan_bad_account",
        "missing": "orphan_bad_account", "bare": "orphan_out_of_window",
    }
    assert {r.log_id: r.usage_class for r in b.int_orphan_usage.collect()} == want
    clean = {r.log_id for r in variants.join_semi_range_usage_contract(b).collect()}
    assert clean == {"start", "end"}
    sides = {r.log_id: r.side for r in variants.split_clean_orphan(b).collect()}
    assert set(sides) == set(want) and {k for k, v in sides.items() if v == "clean"} == clean
    assert {r.log_id for r in variants.join_anti_usage_account(b).collect()} == {"unknown", "ghost", "missing"}
    counts = by(marts.orphan_by_class(b), "usage_class")
    assert counts["orphan_bad_account"].n_logs == 3 and counts["orphan_out_of_window"].n_logs == 3


def test_active_is_inclusive_and_accumulates(make_book):
    b = make_book(
        [contract("C1", start=T, end=T, arr=100), contract("C2", arr=200), contract("C3", start=T + D(1)),
         contract("C4", end=T - D(1))]
    )
    row = b.int_account_active_contracts.first()
    assert (row.n_active_contracts, row.active_committed_arr, row.contract_age_days) == (2, Decimal("300.00"), 200)


def test_no_included_credits_means_trust(make_book):
    row = make_book([contract("C1", included=0)], [("u", "A1", T, 5)]).metric_carr.first()
    assert row.utilization_u is None and row.healthscore == 1.0 and row.carr == 1000.0


def test_no_usage_scores_floor(make_book):
    row = make_book([contract("C1")]).mart_carr_current.first()
    assert (row.utilization_u, row.m1_share, row.healthscore, row.band) == (0.0, None, 0.40, "at_risk_shelfware")


def test_unknown_account_drops_and_idle_rep_stays(make_book):
    b = make_book([contract("C1"), contract("C2", account="GHOST")])
    assert [r.account_id for r in b.metric_carr.collect()] == ["A1"]
    reps = by(b.mart_carr_by_rep, "rep_id")
    assert reps["R1"].n_accounts == 1
    assert (reps["R2"].n_accounts, reps["R2"].carr, reps["R2"].weighted_healthscore, reps["R2"].n_at_risk) == (0, None, None, 0)


def test_dq_summary_is_one_row_on_empty_tables(make_book):
    rows = make_book().mart_dq_summary.collect()
    assert len(rows) == 1
    assert (rows[0].n_accounts, rows[0].n_usage_logs, rows[0].n_accounts_in_metric, rows[0].weighted_healthscore) == (1, 0, 0, None)


def test_assertions_find_planted_errors(make_book):
    b = make_book(
        [
            contract("C1"), contract("C1"), contract("C2", account="GHOST", arr=-5, included=-1),
            contract("C3", start=T, end=T - D(1)),
        ],
        [("u", "A1", T, -1), ("u", "A1", T, 2), ("x", None, T, 2)],
        accounts=[("A1", "a", "BUILDING", "R9"), ("A1", "b", "BUILDING", "R1"), ("A2", "c", "BUILDING", "R1")],
    )
    v = {r.assertion_id: r.violations for r in quality.dq_assertions(b).collect()}
    assert len(v) == 16
    for k, n in {"A01": 0, "A02": 1, "A03": 1, "A04": 1, "A05": 1, "A06": 1, "A07": 1, "A08": 1, "A09": 1, "A10": 1,
                 "A11": 0, "A12": 0, "A13": 1}.items():
        assert v[k] == n, k
    gate = quality.dq_gate(b).first()
    assert gate.exit_code == 1 and gate.exit_code_strict == 1


def test_empty_metric_fails_checks_without_raising(make_book):
    from meterline.plans import evals

    rows = {r.check_id: r for r in evals.eval_results(make_book()).collect()}
    assert len(rows) == 16
    for k in ("T1a", "T1b", "T1c", "T1d", "T3a", "T5a", "T5b", "T5c", "T5d", "T5e"):
        assert rows[k].passed is False


def test_history_equals_snapshot_on_each_day(make_book):
    contracts = [
        contract("C1", start=T - D(400), end=T - D(36), included=90),
        contract("C2", start=T - D(50), end=T + D(300), arr=777, included=33),
        contract("C3", start=T - D(50), end=T - D(45), arr=1),
        contract("C4", start=T - D(20), end=T - D(20), arr=5, included=7),
    ]
    usage = [(f"u{i}", "A1", T - D(i * 3), i + 1) for i in range(60)]
    days = [T - D(k) for k in range(0, 130)]
    b = make_book(contracts, usage)
    many = {r.as_of_date: r for r in history.metric_on(b, history.listed(days)).collect()}
    dense = {r.as_of_date: r for r in history.metric_on(b, history.every_day(days[-1], T)).collect()}
    assert many == dense
    for d in days[::13] + [T - D(20), T - D(36), T - D(35), T - D(45)]:
        one = make_book(contracts, usage, as_of=d).mart_carr_current.first()
        got = many.get(d)
        assert (one is None) == (got is None), d
        if one is not None:
            for c in ("n_active_contracts", "committed_arr", "utilization_u", "m1_share", "healthscore", "carr",
                      "contract_age_days", "band"):
                assert one[c] == got[c], (d, c)


def test_restatement_lists_only_changes(spark):
    schema = "month_end date, account_id string, carr double"
    frozen = spark.createDataFrame([(T, "A", 10.0), (T, "B", 5.0), (T, "C", 1.0)], schema)
    again = spark.createDataFrame([(T, "A", 10.0), (T, "B", 7.5), (T, "D", 2.0)], schema)
    got = {r.account_id: (r.old_value, r.new_value, r.delta) for r in history.restatement_diff(frozen, again).collect()}
    assert got == {"B": (5.0, 7.5, 2.5), "C": (1.0, None, -1.0), "D": (None, 2.0, 2.0)}


def test_spec_variant_trusts_young_account(make_book):
    young = make_book([contract("C1", start=T - D(8))])
    assert variants.spec_healthscore(young).first().healthscore == 1.0
    old = make_book([contract("C1", start=T - D(120))])
    assert variants.spec_healthscore(old).first().healthscore == 0.40


def test_stg_contract_age_is_signed(make_book):
    b = make_book([contract("C1", start=T + D(3))])
    assert b.stg_contracts.select(F.col("contract_age_days")).first()[0] == -3


def test_staging_trims_and_spells_known_values(make_book):
    b = make_book(
        accounts=[("A1", " Acme  Co ", "building ", "R1"), ("A2", "B", "Space Travel", "R1")],
        reps=[("R1", " Rep One", " asia ", "ENTERPRISE")],
    )
    rep = b.stg_sales_reps.first()
    assert (rep.rep_name, rep.region, rep.segment) == ("Rep One", "ASIA", "Enterprise")
    got = {r.account_id: (r.company_name, r.industry, r.region) for r in b.stg_accounts.collect()}
    assert got == {"A1": ("Acme  Co", "BUILDING", "ASIA"), "A2": ("B", "Space Travel", "ASIA")}


def test_primary_contract_of_every_day(make_book):
    rng = __import__("random").Random(1)
    rows = []
    for i in range(60):
        start = T - D(rng.randint(0, 80))
        rows.append(contract(f"C{i:02}", f"A{rng.randint(1, 3)}", start, start + D(rng.randint(-1, 40)), included=rng.randint(1, 4)))
    low, high = T - D(60), T
    got = {(r.account_id, r.day): (r.contract_id, r.included_monthly_credits) for r in intervals.primary_contract_days(
        make_book(rows).stg_contracts, low, high).collect()}
    want = {}
    for n in range(61):
        day = low + D(n)
        for i, a, s, e, _, k in sorted(rows, key=lambda r: (r[5], [-ord(c) for c in r[0]])):
            if s <= day <= e:
                want[a, day] = (i, k)
    assert got == want
