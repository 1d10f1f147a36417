"""The incremental daily table: equal to a full reconciliation after any batches, runs again and stops halfway."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterline.streaming import incremental as I
from meterline.streaming import rollup as R

SCHEMA = "event_id long, event_time timestamp, account_id string, credits decimal(18,2)"


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def batches(seed=1, n=6, size=40):
    """Batches with repeats inside and across batches, earlier copies arriving later, and late days."""
    rnd = random.Random(seed)
    base = datetime(2026, 3, 1)
    out = []
    for b in range(n):
        rows = []
        for _ in range(size):
            eid = rnd.randint(0, 120)
            day = rnd.randint(0, 20) if b < n - 1 else rnd.randint(0, 3)  # the last batch is late
            rows.append((eid, base + timedelta(days=day, seconds=rnd.randint(0, 5)), f"A{rnd.randint(0, 4)}",
                         Decimal(rnd.randint(1, 90)) / 10))
        out.append(rows)
    return out


def expected(spark, all_rows):
    usage = events(spark, all_rows).withColumn("usage_date", F.to_date("event_time"))
    got = R.reconciled(usage).select("usage_date", "account_id", "n_logs", F.col("credits_consumed").cast("decimal(28,2)"))
    return sorted(map(tuple, got.collect()))


def table(spark, folder):
    return sorted(map(tuple, I.read_daily(spark, folder).collect()))


def test_batches_equal_full_reconciliation(spark, tmp_path):
    folder, seen = str(tmp_path / "t"), []
    for i, rows in enumerate(batches()):
        I.upsert(events(spark, rows), i, folder, buckets=4)
        seen += rows
        assert table(spark, folder) == expected(spark, seen)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    folder, seen = str(tmp_path / "t"), []
    for i, rows in enumerate(batches(2, 3)):
        I.upsert(events(spark, rows), i, folder, buckets=4)
        I.upsert(events(spark, rows), i, folder, buckets=4)
        seen += rows
    assert table(spark, folder) == expected(spark, seen)


@pytest.mark.parametrize("stop_at", [1, 2])
def test_stop_between_writes_then_run_again(spark, tmp_path, monkeypatch, stop_at):
    folder, seen = str(tmp_path / "t"), []
    all_batches = batches(3, 3)
    for i, rows in enumerate(all_batches[:2]):
        I.upsert(events(spark, rows), i, folder, buckets=4)
        seen += rows
    calls, real = [], I._write

    def stopping(df, path, column):
        calls.append(path)
        if len(calls) == stop_at:
            if stop_at == 2:
                real(df, path, column)
            raise RuntimeError("stopped")
        real(df, path, column)

    monkeypatch.setattr(I, "_write", stopping)
    with pytest.raises(RuntimeError):
        I.upsert(events(spark, all_batches[2]), 2, folder, buckets=4)
    monkeypatch.undo()
    I.upsert(events(spark, all_batches[2]), 2, folder, buckets=4)
    seen += all_batches[2]
    assert table(spark, folder) == expected(spark, seen)


def test_stream_of_files_with_restart(spark, tmp_path):
    src, folder, state = tmp_path / "src", str(tmp_path / "t"), str(tmp_path / "state")
    parts = batches(4, 4)
    for i, rows in enumerate(parts[:3]):
        events(spark, rows).write.parquet(str(src / f"f{i}"))
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    I.start(read(), folder, state, buckets=4).awaitTermination()
    assert table(spark, folder) == expected(spark, sum(parts[:3], []))
    events(spark, parts[3]).write.parquet(str(src / "f3"))
    I.start(read(), folder, state, buckets=4).awaitTermination()
    assert table(spark, folder) == expected(spark, sum(parts, []))


def test_empty_batch(spark, tmp_path):
    I.upsert(events(spark, []), 0, str(tmp_path / "t"))
