"""Expiry of month partitions: sums kept, safe to stop halfway, late rows counted once; result tables by run."""

import datetime as dt
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterline.params import Params
from meterline.plans.build import append_run, expire, write_all, write_history
from meterline.plans.book import Book
from meterline.sources import retention, schemas, sinks

USAGE = "log_id string, account_id string, usage_date date, credits_consumed decimal(18,2)"


def logs(spark, rows):
    return spark.createDataFrame([(i, a, d, Decimal(c)) for i, a, d, c in rows], USAGE)


ROWS = [
    ("L1", "A1", date(2024, 1, 3), "1.50"), ("L2", "A1", date(2024, 1, 9), "2.00"), ("L3", "A2", date(2024, 1, 9), "4.00"),
    ("L4", "A1", date(2024, 2, 1), "8.00"), ("L5", None, date(2024, 2, 5), "16.00"), ("L6", "A1", date(2024, 3, 5), "32.00"),
]


def measures():
    return [F.sum("credits_consumed").alias("credits_consumed")]


def totals(spark, path):
    """Credits by account over detail and archive together."""
    detail = spark.read.parquet(path).groupBy("account_id").agg(F.sum("credits_consumed").alias("c"))
    try:
        archive = retention.archived(spark, f"{path}_archive").groupBy("account_id").agg(F.sum("credits_consumed").alias("c"))
    except Exception:  # no archive yet
        archive = detail.where("false")
    both = detail.unionByName(archive).groupBy("account_id").agg(F.sum("c").alias("c"))
    return {r.account_id: r.c for r in both.collect()}


def test_expiry_keeps_sums_and_removes_old_months(spark, tmp_path):
    path = str(tmp_path / "usage")
    sinks.write_usage(logs(spark, ROWS), path)
    before = totals(spark, path)
    gone = retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2024, 3, 1), ["account_id"], measures())
    assert gone == [date(2024, 1, 1), date(2024, 2, 1)]
    assert totals(spark, path) == before
    assert sorted(retention.month_folders(spark, path, "usage_month")) == [date(2024, 3, 1)]
    arch = {(r.usage_month, r.account_id): (r.credits_consumed, r.n_detail_rows) for r in retention.archived(spark, f"{path}_archive").collect()}
    assert arch[(date(2024, 1, 1), "A1")] == (Decimal("3.50"), 2) and arch[(date(2024, 2, 1), None)] == (Decimal("16.00"), 1)
    # running again changes nothing
    assert retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2024, 3, 1), ["account_id"], measures()) == []
    assert totals(spark, path) == before


def test_stop_between_aggregate_and_delete_then_rerun(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "usage")
    sinks.write_usage(logs(spark, ROWS), path)
    before = totals(spark, path)
    calls = []

    def stop(spark_, folder):
        calls.append(folder)
        raise RuntimeError("stopped")

    monkeypatch.setattr(retention, "delete_folder", stop)
    with pytest.raises(RuntimeError):
        retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2024, 3, 1), ["account_id"], measures())
    monkeypatch.undo()
    assert calls and sorted(retention.month_folders(spark, f"{path}_archive", "usage_month")) == [date(2024, 1, 1), date(2024, 2, 1)]
    retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2024, 3, 1), ["account_id"], measures())
    assert totals(spark, path) == before  # nothing summed twice


def test_late_rows_for_an_archived_month_count_once(spark, tmp_path):
    path = str(tmp_path / "usage")
    sinks.write_usage(logs(spark, ROWS), path)
    retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2024, 3, 1), ["account_id"], measures())
    late = logs(spark, [("L9", "A2", date(2024, 1, 20), "64.00")]).withColumn("usage_month", F.trunc("usage_date", "month"))
    late.write.mode("append").partitionBy("usage_month").parquet(path)
    retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2024, 3, 1), ["account_id"], measures())
    assert totals(spark, path)["A2"] == Decimal("68.00")
    assert retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2024, 3, 1), ["account_id"], measures()) == []


def test_nothing_due_and_empty_table(spark, tmp_path):
    path = str(tmp_path / "usage")
    assert retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2030, 1, 1), ["account_id"], measures()) == []
    sinks.write_usage(logs(spark, ROWS), path)
    assert retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2020, 1, 1), ["account_id"], measures()) == []


def test_results_by_run_replace_their_own_rows(spark, sf_dir, tmp_path):
    from meterline import registry
    from meterline.plans import catalog

    path = str(tmp_path / "results")
    df = catalog.dq_pk(registry.book(spark, sf_dir))
    n = df.count()
    for k, ts in (("run1", datetime(2024, 1, 5)), ("20260418", datetime(2026, 4, 18)), ("run1", datetime(2024, 1, 5))):
        sinks.put_run(df, path, schemas.ASSERTION_RESULTS, {"run_id": F.lit(k), "run_ts": F.lit(ts)})
    got = sinks.read_runs(spark, path, schemas.ASSERTION_RESULTS)
    assert {r.run_id: r["count"] for r in got.groupBy("run_id").count().collect()} == {"run1": n, "20260418": n}
    assert got.schema["run_id"].dataType.simpleString() == "string"
    gone = retention.expire_months(spark, path, f"{path}_archive", "run_month", date(2024, 4, 1), ["assertion_id", "status"],
                                   [F.countDistinct("run_id").alias("n_runs")])
    assert gone == [date(2024, 1, 1)]
    assert sinks.read_runs(spark, path, schemas.ASSERTION_RESULTS).select("run_id").distinct().collect()[0].run_id == "20260418"
    assert retention.archived(spark, f"{path}_archive").agg(F.sum("n_detail_rows")).first()[0] == n


def test_build_expires_all_tables_and_keeps_sums(spark, sf_dir, tmp_path):
    from meterline.sources.fixture import load

    folder, sources = str(tmp_path), load(spark, sf_dir)
    book = write_history(write_all(spark, sources, folder), folder)
    append_run(book, folder, "r1", datetime(2026, 4, 18, tzinfo=dt.timezone.utc))
    append_run(book, folder, "r1", datetime(2026, 4, 18, tzinfo=dt.timezone.utc))
    assert spark.read.parquet(f"{folder}/row_counts").count() == 13  # the same run twice: once
    credits = lambda: spark.read.parquet(f"{folder}/usage_daily").agg(F.sum("credits_consumed")).first()[0]
    before, n_days = credits(), spark.read.parquet(f"{folder}/carr_account_day").count()
    later = Params(as_of=book.p.as_of.replace(year=book.p.as_of.year + 1))
    gone = expire(spark, folder, later)
    assert len(gone["usage_daily"]) > 0 and len(gone["carr_account_day"]) == 12
    archived = retention.archived(spark, f"{folder}/usage_daily_archive").agg(F.sum("credits_consumed")).first()[0]
    assert credits() + archived == before
    kept = spark.read.parquet(f"{folder}/carr_account_day").count()
    assert kept + retention.archived(spark, f"{folder}/carr_account_day_archive").agg(F.sum("n_detail_rows")).first()[0] == n_days
    assert expire(spark, folder, later) == {k: [] for k in gone}
