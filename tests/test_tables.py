"""Sources, sinks, the stream and access rules through real files."""

import datetime as dt
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from meterline.operators.intervals import in_months
from meterline.plans import catalog, evals, governance, models, quality
from meterline.plans.build import append_run, write_all, write_history
from meterline.plans.book import Book
from meterline.session import ready_for_checkpoint
from meterline.sources import readers, schemas, sinks
from meterline.streaming import rollup as R


def test_csv_keeps_quotes_and_newlines(spark, tmp_path):
    rows = [("A1", 'Line one\nsays "two", three', "BUILDING", "R1")]
    df = spark.createDataFrame(rows, schemas.ACCOUNTS)
    sinks.write_csv(df, str(tmp_path / "a"))
    sinks.write_csv(df, str(tmp_path / "a"))
    back = readers.read_csv(spark, str(tmp_path / "a"), schemas.ACCOUNTS)
    assert [tuple(r) for r in back.collect()] == rows


def test_labels_need_a_source(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_labels(spark, str(tmp_path / "p"), str(tmp_path / "c"))
    df = spark.createDataFrame([("A1", "normal")], schemas.ACCOUNT_ARCHETYPES)
    sinks.write_table(df, str(tmp_path / "p"))
    assert readers.read_labels(spark, str(tmp_path / "p"), str(tmp_path / "c")).count() == 1


def test_month_is_written_once(spark, tmp_path):
    m = date(2026, 3, 31)
    path = str(tmp_path / "frozen")
    df = spark.createDataFrame([(m, "A1", 1.0)], "month_end date, account_id string, carr double")
    sinks.publish_month(df, path, m)
    with pytest.raises(sinks.MonthClosed):
        sinks.publish_month(df.withColumn("carr", F.lit(2.0)), path, m)
    assert [r.carr for r in spark.read.parquet(path).collect()] == [1.0]


def test_merge_replaces_only_touched_months(spark, tmp_path):
    ready_for_checkpoint(spark)
    schema = "log_id string, account_id string, usage_date date, credits_consumed int"
    old = spark.createDataFrame(
        [("a", "A", date(2026, 1, 5), 1), ("b", "A", date(2026, 2, 5), 1), ("c", "A", date(2026, 2, 6), 1)], schema
    )
    new = spark.createDataFrame([("b", "A", date(2026, 2, 5), 9), ("d", "A", date(2026, 3, 1), 4)], schema)
    path = str(tmp_path / "usage")
    sinks.write_usage(old, path)
    before = {f.name for f in (tmp_path / "usage" / "usage_month=2026-01-01").iterdir()}
    sinks.merge_usage(spark, path, new)
    assert {f.name for f in (tmp_path / "usage" / "usage_month=2026-01-01").iterdir()} == before
    got = {r.log_id: r.credits_consumed for r in spark.read.parquet(path).collect()}
    assert got == {"a": 1, "b": 9, "c": 1, "d": 4}


def usage_table(spark, tmp_path, rows):
    ready_for_checkpoint(spark)
    schema = "log_id string, account_id string, usage_date date, credits_consumed int"
    path = str(tmp_path / "usage")
    sinks.write_usage(spark.createDataFrame(rows, schema), path)

    def merge(new):
        sinks.merge_usage(spark, path, spark.createDataFrame(new, schema))
        return sorted((r.log_id, r.usage_date, r.credits_consumed, r.usage_month) for r in spark.read.parquet(path).collect())

    return merge


def test_merge_moves_a_log_to_another_month(spark, tmp_path):
    feb, mar = date(2026, 2, 5), date(2026, 3, 5)
    merge = usage_table(spark, tmp_path, [("a", "A", feb, 1), ("z", "A", date(2026, 1, 1), 7)])
    assert merge([("a", "A", mar, 2)]) == [("a", mar, 2, date(2026, 3, 1)), ("z", date(2026, 1, 1), 7, date(2026, 1, 1))]
    assert merge([("a", "A", feb, 3)])[0] == ("a", feb, 3, date(2026, 2, 1))


def test_merge_keeps_one_version_of_an_incoming_log(spark, tmp_path):
    d = date(2026, 2, 5)
    merge = usage_table(spark, tmp_path, [("a", "A", d, 1)])
    got = merge([("b", "A", d, 4), ("b", "A", date(2026, 2, 6), 3), ("b", "A", d, 9), ("a", "A", d, 5), ("a", "A", d, 5)])
    assert [r[:3] for r in got] == [("a", d, 5), ("b", date(2026, 2, 6), 3)]


def test_published_months_stay(spark, tmp_path):
    schema = "month_end date, account_id string, carr double"
    jan, feb = date(2026, 1, 31), date(2026, 2, 28)
    path = str(tmp_path / "months")
    assert sinks.publish_months(spark.createDataFrame([(jan, "A", 1.0)], schema), path) == []
    files = {f.name: f.read_bytes() for f in (tmp_path / "months" / "month_end=2026-01-31").iterdir()}
    assert sinks.publish_months(spark.createDataFrame([(jan, "A", 9.0), (feb, "A", 2.0)], schema), path) == [jan]
    assert {f.name: f.read_bytes() for f in (tmp_path / "months" / "month_end=2026-01-31").iterdir()} == files
    assert sinks.published_months(spark, path) == [jan, feb]
    assert sorted(r.carr for r in spark.read.parquet(path).collect()) == [1.0, 2.0]


def test_month_filter_prunes_folders(spark, tmp_path):
    rows = [(f"l{i}", "A", date(2025, 1 + i, 3), 1) for i in range(12)]
    usage_table(spark, tmp_path, rows)
    df = sinks.read_table(spark, str(tmp_path / "usage"))
    cut = in_months(df, date(2025, 4, 2), date(2025, 6, 30)).where("usage_date > DATE'2025-04-02'")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_month" in plan and cut.count() == 3


def test_export_has_every_account(spark):
    from meterline import registry

    folder = "/root/testdata/sf0.1"
    assert registry.run("export_csv", spark, folder).count() == registry.run("mart_carr_current", spark, folder).count() > 5000


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("account_id"), "id")
    for name in ("left_side", "right_side"):
        sinks.write_clustered(df, name, str(tmp_path / name), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_side").join(spark.table("right_side"), "account_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_side", "right_side"):
            spark.sql(f"DROP TABLE {name}")


def test_results_append(spark, sf_dir, tmp_path):
    from meterline import registry

    path = str(tmp_path / "results")
    df = catalog.dq_pk(registry.book(spark, sf_dir))
    for k in ("run1", "run2"):
        run = {"run_id": F.lit(k), "run_ts": F.lit(datetime(2026, 4, 18, tzinfo=dt.timezone.utc))}
        sinks.append_results(df, path, schemas.ASSERTION_RESULTS, run)
    got = spark.read.parquet(path)
    assert got.count() == 2 and got.columns == schemas.ASSERTION_RESULTS.names


def test_written_tables_answer_like_plans(spark, sf_dir, tmp_path):
    from meterline.sources.fixture import load

    sources = load(spark, sf_dir)
    book = write_all(spark, sources, str(tmp_path))
    stored = Book.stored(spark, sources, str(tmp_path))
    for b in (book, stored):
        assert all(getattr(b, t) is not None for t in models.TABLES)
    a = quality.dq_assertions(stored).orderBy("assertion_id").collect()
    assert a == quality.dq_assertions(Book(sources)).orderBy("assertion_id").collect()
    readers.register_raw_views(sources)
    assert spark.sql("SELECT COUNT(*) FROM raw_accounts").first()[0] == stored.stg_accounts.count()


def test_history_is_read_from_its_months(spark, sf_dir, tmp_path):
    from meterline.plans import trends
    from meterline.sources.fixture import load

    folder, sources = str(tmp_path), load(spark, sf_dir)
    write_all(spark, sources, folder)
    stored = write_history(Book.stored(spark, sources, folder), folder)
    plan = stored.movement_metric._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_month" in plan
    fresh = Book(sources)
    for q in (trends.trend_12m, trends.rep_rank_delta):
        assert sorted(map(str, q(stored).collect())) == sorted(map(str, q(fresh).collect()))
    for k in ("run1", "run2"):
        append_run(stored, folder, k, datetime(2026, 4, 18, tzinfo=dt.timezone.utc))
    got = spark.read.parquet(f"{folder}/assertion_results").groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in got} == {"run1": 34, "run2": 34}
    assert spark.read.parquet(f"{folder}/eval_results").count() == 32
    assert spark.read.parquet(f"{folder}/row_counts").count() == 26


def test_checks_scan_the_raw_logs_at_most_twice(spark, sf_dir):
    from meterline.sources.fixture import load

    b = Book(load(spark, sf_dir))
    for q in (quality.dq_assertions, evals.eval_results, catalog.dq_catalog, catalog.dq_checksum):
        plan = q(b)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_shipdate") == 0 or plan.count("Relation [l_orderkey") <= 2, q.__name__


def test_backfill_leaves_published_months_alone(spark, sf_dir, tmp_path):
    from meterline.plans import history
    from meterline.sources.fixture import load

    sources, path = load(spark, sf_dir), str(tmp_path / "months")
    rows = history.carr_account_month_end(Book(sources))
    sinks.publish_months(rows, path)
    files = lambda: {str(f): f.read_bytes() for f in (tmp_path / "months").rglob("*.parquet")}
    before = files()
    doubled = sources["daily_usage_logs"].withColumn(
        "compute_credits_consumed", (F.col("compute_credits_consumed") * 2).cast("decimal(18,2)")
    )
    again = history.carr_account_month_end(Book({**sources, "daily_usage_logs": doubled}))
    assert len(sinks.publish_months(again, path)) == rows.select("month_end").distinct().count()
    assert files() == before
    diff = history.restatement_diff(spark.read.parquet(path), again, 500.0)
    old, new = ({(r.month_end, r.account_id): r.carr for r in df.collect()} for df in (rows, again))
    moved = {k: abs(new[k] - old[k]) > 500 for k in old if old[k] != new[k]}
    assert {(r.as_of_month, r.account_id): r.needs_restatement for r in diff.collect()} == moved and moved


def test_report_delta_shows_new_and_changed(spark):
    schema = "check_id string, passed boolean, observed double"
    old = spark.createDataFrame([("T1a", True, 1.0), ("T2a", True, 0.0)], schema)
    new = spark.createDataFrame([("T1a", False, 0.5), ("T9x", True, 2.0)], schema)
    got = {r.check_id: (r.status_changed, r.observed_change) for r in evals.eval_report_delta(old, new).collect()}
    assert got == {"T1a": (True, -0.5), "T2a": (True, None), "T9x": (True, None)}


def test_manager_sees_everyone_below(make_book, spark):
    lines = spark.createDataFrame([("R1", "R2"), ("R2", "R3"), ("R3", "R4"), ("R4", "R5")], "rep_id string, manager_id string")
    reps = [(f"R{i}", f"Rep {i}", "ASIA", "Enterprise") for i in range(1, 6)]
    b = make_book(reps=reps, rep_manager=lines)
    got = {(r.viewer_id, r.rep_id): r.depth for r in governance.manager_closure(b).collect()}
    assert got == {(f"R{j}", f"R{i}"): j - i for i in range(1, 6) for j in range(i, 6)}
    circle = make_book(reps=reps, rep_manager=lines.union(spark.createDataFrame([("R5", "R1")], lines.schema)))
    with pytest.raises(ValueError):
        governance.manager_closure(circle)


def events(spark, rows):
    return spark.createDataFrame([(i, t, 7, "use", v, None) for i, t, v in rows], R.EVENTS)


def test_stream_drops_late_and_repeated_events(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    ts = lambda d, h=1: datetime(2026, 1, d, h)
    rolled = lambda: R.daily_rollup(R.usage_events(R.read_events(spark, src)))
    events(spark, [(1, ts(1), 1.0), (1, ts(1), 1.0), (2, ts(1, 5), 2.0), (3, ts(6), 4.0)]).write.parquet(src)
    R.start(rolled(), out, state).awaitTermination()
    # Day 1 is closed now: its late event is dropped, and the repeated event 3 counts once.
    events(spark, [(4, ts(1), 100.0), (3, ts(6), 4.0), (5, ts(12), 8.0)]).write.mode("append").parquet(src)
    R.start(rolled(), out, state).awaitTermination()
    got = {r.usage_date: (r.n_logs, float(r.credits_consumed)) for r in spark.read.parquet(out).collect()}
    assert got == {date(2026, 1, 1): (2, 3.0), date(2026, 1, 6): (1, 4.0)}


def test_landed_stream_loses_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    ts = lambda d, h=1: datetime(2026, 1, d, h)
    for mode, rows in (
        ("error", [(1, ts(1), 1.0), (1, ts(1), 1.0), (2, ts(1, 5), 2.0), (3, ts(6), 4.0)]),
        ("append", [(4, ts(1), 100.0), (3, ts(6), 4.0), (5, ts(12), 8.0)]),
    ):
        events(spark, rows).write.mode(mode).parquet(src)
        R.land(R.usage_events(R.read_events(spark, src)), out, state).awaitTermination()
    landed = R.landed(spark, out)
    assert landed.count() == 7
    got = {r.usage_date: (r.n_logs, float(r.credits_consumed)) for r in R.reconciled(landed).collect()}
    assert got == {date(2026, 1, 1): (3, 103.0), date(2026, 1, 6): (1, 4.0), date(2026, 1, 12): (1, 8.0)}
