"""Merges through the id index: untouched months are never read, results equal a rebuild, the index stays true."""

import random
import shutil
from datetime import date, timedelta

from pyspark.sql import functions as F

from meterline.session import ready_for_checkpoint
from meterline.sources import retention, sinks

SCHEMA = "log_id string, account_id string, usage_date date, credits_consumed int"


def rows(n, seed, start=date(2025, 1, 1), days=365):
    rnd = random.Random(seed)
    return [(f"L{rnd.randint(0, 4 * n)}", f"A{rnd.randint(0, 9)}", start + timedelta(days=rnd.randint(0, days - 1)),
             rnd.randint(1, 50)) for _ in range(n)]


def rebuilt(old, new):
    """Plain merge: the latest day, then most credits, then account of each incoming id replaces every stored row of it."""
    best = {}
    for r in new:
        if r[0] not in best or (r[2], r[3], r[1]) > (best[r[0]][2], best[r[0]][3], best[r[0]][1]):
            best[r[0]] = r
    out = [r for r in old if r[0] not in best] + list(best.values())
    return sorted((r[0], r[1], r[2], r[3]) for r in out)


def table(spark, path):
    return sorted((r.log_id, r.account_id, r.usage_date, r.credits_consumed) for r in spark.read.parquet(path).collect())


def index_of(spark, path):
    got = spark.read.parquet(f"{path}/{sinks.LOG_INDEX}").select("h", "usage_month")
    return sorted(map(tuple, got.collect()))


def fresh_index(spark, path):
    got = spark.read.parquet(path).select(F.xxhash64("log_id").alias("h"), "usage_month")
    return sorted(map(tuple, got.collect()))


def test_merge_by_index_equals_rebuild_and_index_stays_true(spark, tmp_path):
    ready_for_checkpoint(spark)
    path = str(tmp_path / "usage")
    old = rows(400, 1)
    sinks.write_usage(spark.createDataFrame(old, SCHEMA), path)
    assert index_of(spark, path) == fresh_index(spark, path)
    new = rows(60, 2, date(2025, 11, 1), 61) + [r[:3] + (999,) for r in old[:5]]  # some ids move months
    sinks.merge_usage(spark, path, spark.createDataFrame(new, SCHEMA))
    assert table(spark, path) == rebuilt(old, new)
    assert index_of(spark, path) == fresh_index(spark, path)


def test_untouched_months_are_not_read(spark, tmp_path):
    ready_for_checkpoint(spark)
    path = tmp_path / "usage"
    old = [("a", "A", date(2025, 1, 5), 1), ("b", "A", date(2025, 2, 5), 1), ("c", "A", date(2025, 3, 6), 1)]
    sinks.write_usage(spark.createDataFrame(old, SCHEMA), str(path))
    # January is made unreadable: a merge that read it would fail
    for f in (path / "usage_month=2025-01-01").iterdir():
        if f.suffix == ".parquet":
            f.write_bytes(b"not parquet")
    sinks.merge_usage(spark, str(path), spark.createDataFrame([("b", "A", date(2025, 2, 5), 9), ("d", "A", date(2025, 4, 1), 4)], SCHEMA))
    shutil.rmtree(path / "usage_month=2025-01-01")
    assert table(spark, str(path)) == [("b", "A", date(2025, 2, 5), 9), ("c", "A", date(2025, 3, 6), 1), ("d", "A", date(2025, 4, 1), 4)]


def test_without_index_the_merge_searches_all_months(spark, tmp_path):
    ready_for_checkpoint(spark)
    path = tmp_path / "usage"
    old = rows(100, 3)
    sinks.write_usage(spark.createDataFrame(old, SCHEMA), str(path))
    shutil.rmtree(path / sinks.LOG_INDEX)
    new = [r[:3] + (777,) for r in old[:3]]
    sinks.merge_usage(spark, str(path), spark.createDataFrame(new, SCHEMA))
    assert table(spark, str(path)) == rebuilt(old, new)


def test_expiry_drops_the_index_of_expired_months(spark, tmp_path):
    ready_for_checkpoint(spark)
    path = str(tmp_path / "usage")
    old = rows(200, 4)
    sinks.write_usage(spark.createDataFrame(old, SCHEMA), path)
    retention.expire_months(spark, path, f"{path}_archive", "usage_month", date(2025, 7, 1), ["account_id"],
                            [F.sum("credits_consumed").alias("credits_consumed")])
    assert index_of(spark, path) == fresh_index(spark, path)
    moved = [r for r in old if r[2] >= date(2025, 7, 1)][:2]
    new = [(r[0], r[1], r[2], 5) for r in moved]
    sinks.merge_usage(spark, path, spark.createDataFrame(new, SCHEMA))
    assert sorted(retention.month_folders(spark, path, "usage_month"))[0] >= date(2025, 7, 1)  # no expired month comes back
