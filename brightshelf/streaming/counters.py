"""Search counters as streams."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How late an event may be and still count.
LATE = "1 hour"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The events table as a stream; its times are made ones that a watermark can follow."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, width: str = "1 day", *keys: str) -> DataFrame:
    """(bucket, keys, count) by tumbling windows; to be written in update or complete mode."""
    rows = events.withWatermark("ts", LATE).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("count"))
    return rows.select(F.col("w.start").alias("bucket"), *keys, "count")


def sliding_counts(events: DataFrame, width: str = "1 hour", every: str = "15 minutes", *keys: str) -> DataFrame:
    rows = events.withWatermark("ts", LATE).groupBy(F.window("ts", width, every).alias("w"), *keys).agg(F.count("*").alias("count"))
    return rows.select(F.col("w.start").alias("bucket"), *keys, "count")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, count): a user's events that are no further apart than the gap."""
    rows = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("count"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def recent_means(events: DataFrame, key: str = "event_type", value: str = "value", n: int = 1000) -> DataFrame:
    """(key, n, mean) of each key's last n values, by a state that holds no more than these."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held.extend(zip(b["at"].tolist(), b["v"].tolist(), strict=True))
        held = sorted(held)[-n:]
        state.update(([a for a, _ in held], [v for _, v in held]))
        yield pd.DataFrame({key: [k[0]], "n": [len(held)], "mean": [sum(v for _, v in held) / len(held)]})

    rows = events.where(F.col(value).isNotNull()).select(key, F.unix_micros("ts").alias("at"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} string, n long, mean double", "at array<long>, v array<double>", "update", "NoTimeout")


class Ring(StatefulProcessor):
    """A key's values in buckets of time, which leave the state by themselves.

    The state holds, for each bucket, the number and sum of its values; a timer drops a bucket when the watermark has passed its
    beginning by ``kept``. So it does not grow with the stream, and a batch rewrites no more than the buckets that it touches.
    (Entries that expire by the clock, by a TTL, are not to be had together with the stream's own time.)
    """

    def __init__(self, key: str, bucket_ms: int, kept_ms: int):
        self.key, self.bucket, self.kept = key, bucket_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket long", "n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            starts = batch["at"] // self.bucket * self.bucket
            for start, part in batch["v"].groupby(starts):
                n, total = self.buckets.getValue((int(start),)) if self.buckets.containsKey((int(start),)) else (0, 0.0)
                self.buckets.updateValue((int(start),), (int(n) + len(part), float(total) + float(part.sum())))
                self.handle.registerTimer(int(start) + self.kept)
        yield self._now(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.kept
        if self.buckets.containsKey((due,)):
            self.buckets.removeKey((due,))
        yield self._now(key)

    def _now(self, key) -> pd.DataFrame:
        rows = [(b[0], v[0], v[1]) for b, v in self.buckets.iterator()]
        n = sum(r[1] for r in rows)
        return pd.DataFrame({self.key: [key[0]], "n": [n], "mean": [sum(r[2] for r in rows) / n if n else None], "buckets": [len(rows)]})

    def close(self) -> None:
        pass


#: What the state of Ring needs of its session.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bucketed_means(events: DataFrame, key: str = "event_type", value: str = "value", bucket: str = "1 hour", kept: str = "7 days") -> DataFrame:
    """(key, n, mean, buckets) of the values of the last ``kept``, by a state of buckets that expire (see Ring); to be written in
    update mode. The session must keep its state in RocksDB (ROCKS): see to_table()."""
    ms = lambda t: int(pd.Timedelta(t).total_seconds() * 1000)
    rows = events.withWatermark("ts", LATE).where(F.col(value).isNotNull()).select(key, "ts", F.unix_millis("ts").alias("at"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(key).transformWithStateInPandas(Ring(key, ms(bucket), ms(kept)), f"{key} string, n long, mean double, buckets long", "update", "eventTime")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting for as long as a block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the one that driver and executors share; a temporary one only for a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brightshelf-")
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def to_table(stream: DataFrame, keys: list[str] | None = None, rocks: bool = False) -> DataFrame:
    """Everything that is there now, run to its end into the shared folder, a folder for each batch.

    Without ``keys`` each batch is the whole result, so the last one is read; with them batches are updates, so the last
    row of each key is. ``rocks`` keeps the state in RocksDB.
    """
    spark, path, numbers = stream.sparkSession, shared_folder(stream.sparkSession, "stream"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        numbers.append(number)

    mode = "update" if keys else "complete"
    with setting(spark, *ROCKS) if rocks else nullcontext():
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").foreachBatch(write).trigger(availableNow=True).start()
        running.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    if not keys:
        return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={max(numbers)}")
    rows = spark.read.parquet(f"{path}/rows")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in others)).select(*stream.columns)


def append_counts(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch's counts under its own number, so that a batch that is run twice counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
