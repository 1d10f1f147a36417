"""The report delta read from stored runs: the two latest by run time, whatever their ids; a run written twice is one."""

from datetime import datetime

from pyspark.sql import functions as F

from meterline.plans import evals
from meterline.sources import schemas, sinks

ROWS = "check_id string, tier string, passed boolean, observed double"


def store(spark, folder, run_id, ts, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("test_id", F.col("check_id")).withColumn(
        "status", F.when(F.col("passed"), "pass").otherwise("fail"))
    sinks.put_run(df, f"{folder}/eval_results", schemas.EVAL_RESULTS, {"run_id": F.lit(run_id), "run_ts": F.lit(ts)})


def test_two_latest_runs_by_time(spark, tmp_path):
    folder = str(tmp_path)
    store(spark, folder, "zz-old", datetime(2026, 1, 1), [("T1", "a", True, 1.0), ("T2", "a", True, 5.0)])
    store(spark, folder, "aa-new", datetime(2026, 3, 1), [("T1", "a", False, 3.0), ("T3", "b", True, 7.0)])
    store(spark, folder, "mm-mid", datetime(2026, 2, 1), [("T1", "a", True, 2.0), ("T2", "a", True, 5.5)])
    store(spark, folder, "mm-mid", datetime(2026, 2, 1), [("T1", "a", True, 2.0), ("T2", "a", True, 5.0)])  # again: replaces
    got = {r.check_id: r for r in evals.stored_report_delta(spark, folder).collect()}
    assert {r.prev_run_id for r in got.values()} == {"mm-mid"} and {r.curr_run_id for r in got.values()} == {"aa-new"}
    assert got["T1"].status_changed and got["T1"].observed_change == 1.0
    assert got["T2"].prev_observed == 5.0 and got["T2"].curr_passed is None
    assert got["T3"].prev_passed is None and got["T3"].status_changed


def test_one_run_only(spark, tmp_path):
    store(spark, str(tmp_path), "r1", datetime(2026, 1, 1), [("T1", "a", True, 1.0)])
    rows = evals.stored_report_delta(spark, str(tmp_path)).collect()
    assert [(r.check_id, r.prev_passed, r.curr_passed, r.prev_run_id) for r in rows] == [("T1", None, True, None)]


def test_row_counts_are_taken_while_writing_and_compared_by_run(spark, sf_dir, tmp_path):
    from meterline.plans import governance, models
    from meterline.plans.build import append_run, write_all
    from meterline.sources.fixture import load

    folder = str(tmp_path)
    book = write_all(spark, load(spark, sf_dir), folder)
    for t in models.TABLES:
        assert book.written_rows[t] == spark.read.parquet(f"{folder}/{t}").count()
    counts = {t: book.written_rows[t] for t in models.TABLES}
    for t, run in ((datetime(2026, 4, 17), "b"), (datetime(2026, 4, 18), "a")):
        if run == "a":  # the later run lost a fifth of one table
            book.written_rows = counts | {"mart_carr_current": int(counts["mart_carr_current"] * 0.8)}
        append_run(book, folder, run, t)
    got = {r.table_name: r for r in governance.stored_row_counts(spark, folder).collect()}
    assert {r.run_id for r in got.values()} == {"a"} and len(got) == len(models.TABLES)
    assert got["mart_carr_current"].alert_decrease and got["mart_carr_current"].alert_change
    assert not got["stg_accounts"].alert_change and got["stg_accounts"].change_pct == 0.0
