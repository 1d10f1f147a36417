"""Digests of published months: order-free, and a changed month is found from the digests alone."""

from datetime import date

from pyspark.sql import functions as F

from meterline.sources import sinks

SCHEMA = "month_end date, account_id string, carr double"


def test_changed_month_found_without_reading_published_rows(spark, tmp_path):
    rows = [(date(2026, m, 28), f"A{i}", float(i * m)) for m in (1, 2, 3) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = tmp_path / "frozen"
    sinks.publish_months(df, str(path))
    same = df.repartition(7, F.rand(3))
    assert {r.month_end: r.matches for r in sinks.changed_months(same, str(path)).collect()} == {
        date(2026, 1, 28): True, date(2026, 2, 28): True, date(2026, 3, 28): True}
    # published rows made unreadable: the comparison needs the digests only
    for f in path.glob("month_end=*/*.parquet"):
        f.write_bytes(b"gone")
    edited = df.withColumn("carr", F.when((F.col("account_id") == "A7") & (F.month("month_end") == 2), 1e9).otherwise(F.col("carr")))
    got = {r.month_end: r.matches for r in sinks.changed_months(edited, str(path)).collect()}
    assert got == {date(2026, 1, 28): True, date(2026, 2, 28): False, date(2026, 3, 28): True}
    fewer = df.where("account_id <> 'A3' OR month(month_end) <> 3")
    assert not {r.month_end: r.matches for r in sinks.changed_months(fewer, str(path)).collect()}[date(2026, 3, 28)]


def test_an_order_dependent_sum_is_found(spark, tmp_path):
    # the same three values summed in two orders: (1 + 1e16) - 1e16 = 0, (-1e16 + 1e16) + 1 = 1
    def rolled(values):
        total = F.aggregate(F.array(*[F.lit(v) for v in values]), F.lit(0.0), lambda a, x: a + x)
        return spark.createDataFrame([(date(2026, 1, 31), "A1")], "month_end date, account_id string").withColumn("carr", total)

    forward, backward = rolled([1.0, 1e16, -1e16]), rolled([-1e16, 1e16, 1.0])
    assert forward.first().carr != backward.first().carr
    path = str(tmp_path / "frozen")
    sinks.publish_months(forward, path)
    assert [r.matches for r in sinks.changed_months(backward, path).collect()] == [False]
    assert [r.matches for r in sinks.changed_months(forward, path).collect()] == [True]


def test_a_month_without_digest_does_not_match(spark, tmp_path):
    df = spark.createDataFrame([(date(2026, 1, 31), "A1", 1.0)], SCHEMA)
    path = str(tmp_path / "frozen")
    sinks.publish_months(df, path)
    later = spark.createDataFrame([(date(2026, 2, 28), "A1", 1.0)], SCHEMA)
    assert [r.matches for r in sinks.changed_months(later, path).collect()] == [False]
