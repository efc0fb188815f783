"""States that old buckets leave."""

import os

from pyspark.sql import functions as F

from brightshelf.streaming import counters


def streamed(spark, folder, times):
    """One file a batch: [(time, value), ...] for each."""
    folder.mkdir()
    for k, rows in enumerate(times):
        made = spark.createDataFrame([(t, "view", v) for t, v in rows], "ts string, event_type string, value double")
        made.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.parquet(str(folder.parent / f"w{k}"))
        [part] = [p for p in (folder.parent / f"w{k}").iterdir() if p.suffix == ".parquet"]
        part.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(folder))


TIMES = [[("2024-01-01 10:00:00", 1.0), ("2024-01-01 10:30:00", 2.0), ("2024-01-01 12:00:00", 3.0)], [("2024-01-03 10:00:00", 10.0)], [("2024-01-03 10:05:00", 20.0), ("2024-01-03 11:00:00", None)]]


def test_old_buckets_leave_the_state(spark, tmp_path):
    got = lambda name, kept: counters.to_table(counters.bucketed_means(streamed(spark, tmp_path / name / "f", TIMES), kept=kept), ["event_type"], rocks=True).first()
    for name in ("short", "long"):
        (tmp_path / name).mkdir()
    short, long = got("short", "1 day"), got("long", "30 days")
    # The watermark passes the first day's buckets by a day, those of the last day stay.
    assert (short["n"], short["mean"], short["buckets"]) == (2, 15.0, 1)
    assert (long["n"], long["mean"], long["buckets"]) == (5, 7.2, 3)


def test_a_ring_of_nothing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "none"))
    assert counters.to_table(counters.bucketed_means(stream), ["event_type"], rocks=True).collect() == []
    assert spark.conf.get(counters.ROCKS[0]) != counters.ROCKS[1]


def test_other_windows(spark, tmp_path):
    """Sliding windows, and counts that a batch which runs twice writes once."""
    stream = counters.sliding_counts(streamed(spark, tmp_path / "f", TIMES[:1]), "1 hour", "30 minutes")
    rows = {str(r["bucket"]): r["count"] for r in counters.to_table(stream).collect()}
    assert rows["2024-01-01 10:00:00"] == 2 and rows["2024-01-01 09:30:00"] == 1
    stream = counters.counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "f")), "1 day")
    for k in range(2):
        counters.append_counts(stream, str(tmp_path / "out"), str(tmp_path / f"p{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 3
