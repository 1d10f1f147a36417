"""Full refresh of a snapshot: writes every table, then reads the marts back for the checks.

The shared roll-ups are written first and the later tables read them. The usage logs are classified once, for the row-level
orphan table; the (account, day) roll-up is summed from that table, class included.
"""

from __future__ import annotations

import argparse
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import usage as U
from ..params import Params
from ..session import build_session
from ..sources import schemas
from ..sources.fixture import load
from ..sources.readers import read_sources, register_raw_views
from ..sources.retention import expire_months
from ..sources.sinks import publish_months, put_run, read_table, write_table, write_usage
from . import catalog, evals, history, models, quality
from .book import Book

MONTHLY = ("stg_daily_usage_logs", "usage_daily")


def write_all(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    folder: str,
    params: Params | None = None,
) -> Book:
    """Write all tables under ``folder``; each is read back before the tables that depend on it are planned.

    The staged logs and the daily usage are partitioned by month.
    """
    book = Book(sources, params)
    book.written_rows = {}
    for name in models.WRITE_ORDER:
        path = f"{folder}/{name}"
        # rows are counted by the write itself, so no second scan is needed for the run's row counts
        seen = Observation(name)
        rows = getattr(book, name).observe(seen, F.count(F.lit(1)).alias("n_rows"))
        if name in MONTHLY:
            write_usage(rows, path)
        else:
            write_table(rows, path)
        book.written_rows[name] = seen.get["n_rows"]
        setattr(book, name, read_table(spark, path))
        if name == "stg_daily_usage_logs":
            book.stg_daily_usage_logs = book.stg_daily_usage_logs.drop("usage_month")
        if name == "int_orphan_usage":
            book.usage_daily = U.daily_of_classified(book.int_orphan_usage)
        if name == "usage_daily":
            book.usage_rollup = book.usage_daily.drop("usage_class")
            book.valid_daily = book.usage_daily.where("usage_class = 'valid'").drop("usage_class")
    return book


def write_history(book: Book, folder: str) -> Book:
    """The daily mart of the hot period by month, and all month-ends, each published once; returns a book that reads them."""
    write_usage(history.carr_account_day(book), f"{folder}/carr_account_day", "as_of_date")
    publish_months(history.carr_account_month_end(book), f"{folder}/carr_account_month_end")
    return book.with_history(folder)


def append_run(book: Book, folder: str, run_id: str, run_ts: datetime) -> None:
    """One run's check results, evaluations and row counts, added to the result tables; the same run again replaces them."""
    run = {"run_id": F.lit(run_id), "run_ts": F.lit(run_ts)}
    put_run(catalog.dq_catalog(book), f"{folder}/assertion_results", schemas.ASSERTION_RESULTS, run)
    status = F.when(F.col("passed"), "pass").otherwise("fail")
    results = evals.eval_results(book).withColumn("test_id", F.col("check_id")).withColumn("status", status)
    put_run(results, f"{folder}/eval_results", schemas.EVAL_RESULTS, run)
    written = getattr(book, "written_rows", {})
    if all(t in written for t in models.TABLES):
        # counted while the tables were written: a small table of literals, no scan
        counts = book.spark.createDataFrame([(t, int(written[t])) for t in models.TABLES], "table_name string, n_rows long")
    else:
        counts = reduce(
            DataFrame.unionByName,
            [getattr(book, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows")) for t in models.TABLES],
        )
    put_run(counts, f"{folder}/row_counts", schemas.ROW_COUNTS, run)


def months_back(day: date, months: int) -> date:
    """First day of the month ``months`` before the month of ``day``."""
    y, m = divmod(day.year * 12 + day.month - 1 - months, 12)
    return date(y, m + 1, 1)


def expire(spark: SparkSession, folder: str, p: Params, result_months: int = 24) -> dict[str, list[date]]:
    """Retention of a built folder: months wholly before the hot period are aggregated into ``<table>_archive``, then their
    daily detail goes. Usage and the daily mart keep ``p.retention_months``; result tables ``result_months`` of runs.

    Safe to stop at any point and run again (see ``retention.expire_months``). Returns the months removed per table.
    """
    hot = date(p.retention_from.year, p.retention_from.month, 1)
    runs = months_back(p.as_of, result_months)
    money = lambda c: F.sum(c).alias(c)
    last = lambda c: F.max_by(c, "as_of_date").alias(f"last_{c}")
    plans = {
        "stg_daily_usage_logs": ("usage_month", hot, ["account_id"], [money("credits_consumed")]),
        "usage_daily": ("usage_month", hot, ["account_id", "usage_class"], [money("n_logs"), money("credits_consumed")]),
        "carr_account_day": ("usage_month", hot, ["account_id"],
                             [last("carr"), last("committed_arr"), F.avg("carr").alias("mean_carr")]),
        "assertion_results": ("run_month", runs, ["assertion_id", "status"], [F.countDistinct("run_id").alias("n_runs")]),
        "eval_results": ("run_month", runs, ["test_id", "status"], [F.countDistinct("run_id").alias("n_runs")]),
    }
    return {
        name: expire_months(spark, f"{folder}/{name}", f"{folder}/{name}_archive", column, cutoff, keys, measures)
        for name, (column, cutoff, keys, measures) in plans.items()
    }


def main() -> int:
    ap = argparse.ArgumentParser(description="Build all tables of a snapshot and run the checks.")
    ap.add_argument("--fixture", help="folder of the given star-schema parquet tables")
    ap.add_argument("--sources", help="folder of the four source tables")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--out", required=True)
    ap.add_argument("--as-of", type=date.fromisoformat, default=Params.as_of)
    ap.add_argument("--run-id", help="also write history and append this run's results to the result tables")
    ap.add_argument("--run-ts", type=datetime.fromisoformat, help="time of the run, with the run id")
    ap.add_argument("--strict", action="store_true", help="warnings also fail the run")
    a = ap.parse_args()
    spark = build_session()
    sources = load(spark, a.fixture) if a.fixture else read_sources(spark, a.sources, a.format)
    register_raw_views(sources)
    book = write_all(spark, sources, a.out, Params(as_of=a.as_of))
    if a.run_id:
        append_run(write_history(book, a.out), a.out, a.run_id, a.run_ts or datetime.combine(a.as_of, datetime.min.time()))
        expire(spark, a.out, book.p)
    book.mart_dq_summary.show(vertical=True, truncate=False)
    quality.dq_assertions(book).orderBy("assertion_id").show(50, truncate=False)
    gate = quality.dq_gate(book).first()
    evals.eval_tier_summary(book).orderBy("tier").show()
    return int(gate["exit_code_strict"] if a.strict else gate["exit_code"])


if __name__ == "__main__":
    raise SystemExit(main())
