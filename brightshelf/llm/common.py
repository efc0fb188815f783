"""What several corpus operators share: stored intermediate tables, hot groups, components."""

from __future__ import annotations

import ctypes
import gc
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: A small side is broadcast only when its counted rows stay below this; else it is joined by a shuffle.
BROADCAST_ROWS = 20_000


#: Rows and bytes of documents that go to a Python worker at a time.
DOCUMENT_ROWS, DOCUMENT_BYTES = 1000, 8 << 20


def document_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session is set to hand over documents in small batches: their texts may be long."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(DOCUMENT_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(DOCUMENT_BYTES))
    return df


def given_back(batches: Iterator) -> Iterator:
    """The batches; when they are at their end, the worker's free memory goes back to the machine.

    Workers outlive their tasks, and several kinds of them stand beside one executor.
    """
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brightshelf-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stored:
    """A DataFrame written to the shared folder, so that what follows neither recomputes it nor needs its executors."""

    #: Those that are still there.
    there: list[Stored] = []

    def __init__(self, df: DataFrame, what: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self._files().deleteOnExit(self._path())
        Stored.there.append(self)

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        """Before the session's end, where nothing reads it any more."""
        if self in Stored.there:
            Stored.there.remove(self)
            self._files().delete(self._path(), True)


def stored(df: DataFrame, what: str) -> DataFrame:
    return Stored(df, what).df


def completed(make: Callable[[], DataFrame], what: str) -> Stored:
    """What ``make`` returns, stored; the tables that were stored on the way to it are dropped."""
    before = set(map(id, Stored.there))
    out = Stored(make(), what)
    for x in [x for x in Stored.there if x is not out and id(x) not in before]:
        x.drop()
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name + "_" * k for k in range(len(taken) + 1)) if x.lower() not in taken)


def input_bytes(df: DataFrame) -> int:
    """The size of what a plan reads, as Spark knows it of its files; what it does not know counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)


def literal(value, kind: str) -> Column:
    """A constant of the plan."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def attach_small(df: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a side that is broadcast only if it was counted and is small; the side should be stored."""
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if small else side, on, "left")


def split_hot(df: DataFrame, keys: list[str], member: str, cap: int) -> DataFrame:
    """Deal groups of over ``cap`` rows to several tasks so that each two of their rows still meet once.

    A group of n rows becomes s = ceil(n / cap) chunks; each row goes to the s pairs of chunks (i, j), i <= j, that hold
    its own chunk. Adds ``part_i``, ``part_j`` and ``side`` (0: the row is of chunk i, 1: of chunk j). Groups of one row
    are left out, as they hold no pair.
    """
    counts = Stored(df.groupBy(*keys).count().where("count > 1"), "group-counts")
    hot = counts.df.where(F.col("count") > cap)
    paired = df.join(counts.df.select(*keys).withColumn("__paired", F.lit(True)), keys, "left_semi")
    if hot.isEmpty():
        return paired.withColumns({"part_i": F.lit(0), "part_j": F.lit(0), "side": F.lit(0)})
    chunks = attach_small(paired, hot.select(*keys, F.ceil(F.col("count") / cap).cast("int").alias("__s")), keys)
    own = F.pmod(F.xxhash64(member), F.coalesce("__s", F.lit(1))).cast("int")
    return (
        chunks.withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.coalesce("__s", F.lit(1)) - 1)))
        .withColumns({"part_i": F.least("__own", "__other"), "part_j": F.greatest("__own", "__other"), "side": (F.col("__own") > F.col("__other")).cast("int")})
        .drop("__s", "__own", "__other")
    )


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges a-b; all in one task."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b: long) with the smallest node it reaches.

    Alternating large-star and small-star rounds: every round is two aggregations with partial sums and two joins, the
    number of rounds grows with the logarithm of the longest chain, and no neighbour list is ever gathered. Each round
    is written to the shared folder. Nodes without an edge do not appear.
    """
    now = Stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _state(now.df)
    while seen[0]:
        both = now.df.union(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = Stored(large, "links")
        low = large.df.groupBy("a").agg(F.min("b").alias("m"))
        small = large.df.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = Stored(small, "links")
        state = _state(after.df)
        now.drop()
        large.drop()
        now = after
        if state == seen:
            break
        seen = state
    stars = now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("b", "a"), 1 << 40)), F.lit(0))).first())
