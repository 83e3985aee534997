from datetime import datetime

from ledgerloom.streaming import unmatched_after, windowed_matches


def _streams(spark, tmp_path):
    a = spark.createDataFrame([("I1", datetime(2024, 1, 1)), ("I2", datetime(2024, 1, 2)), ("I9", datetime(2024, 3, 1))], "inv string, at timestamp")
    b = spark.createDataFrame([("I1", datetime(2024, 1, 5)), ("I2", datetime(2024, 1, 20)), ("I9", datetime(2024, 3, 2)), ("ZZ", datetime(2024, 3, 2))], "ref string, paid_at timestamp")
    for df, name in ((a, "a"), (b, "b")):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    return [spark.readStream.schema(df.schema).parquet(str(tmp_path / n)) for df, n in ((a, "a"), (b, "b"))]


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_matches_within_a_window(spark, tmp_path):
    a, b = _streams(spark, tmp_path)
    _run(windowed_matches(a, b, "inv", "ref", "at", "paid_at", 7).select("inv", "paid_at"), "stream_matches")
    assert {r.inv for r in spark.table("stream_matches").collect()} == {"I1", "I9"}


def test_unmatched_when_the_window_has_passed(spark, tmp_path):
    a, b = _streams(spark, tmp_path)
    _run(unmatched_after(a, b, "inv", "ref", "at", "paid_at", 7), "stream_unmatched")
    assert {r.inv for r in spark.table("stream_unmatched").collect()} == {"I2"}
