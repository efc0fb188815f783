"""Compression of vectors to codes: each of their parts becomes the index of its nearest codebook entry, found by a ball tree."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Stored, given_back, literal

#: Parts of a vector, entries of a part's codebook, rounds of refinement, and integers of a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a ball that is not divided.
LEAF = 4
#: What a bound gives way by, above the error of a few roundings.
SLACK = 1e-12
#: Sums travel as pieces of so many bits, so that no number of rows overflows them.
LIMB = 32
#: Rows that one label's error is copied for where labels are too many to be broadcast.
SALTS = 32


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64 where all fit, or else as Python's integers."""
    scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    whole = lambda x: int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)
    return np.array([[whole(x) for x in row] for row in values.tolist()], dtype=object)


def safe(values: np.ndarray, width: int) -> bool:
    """Whether squared distances of ``width`` components up to these fit int64."""
    return values.dtype != object and (not values.size or width * (2 * int(np.abs(values).max())) ** 2 < 1 << 62)


class Balls:
    """Entries of one part position in nested balls, for nearest() by branch and bound.

    Centres are integers, so that distances to them are exact up to the root. Radii are rounded up and bounds down; a ball
    is visited if its bound is not above the best distance so far, which leaves no tie out; what is compared at last are
    integers. Where the numbers are too large for int64, Python's are compared, without pruning.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries if safe(entries, entries.shape[1]) else entries.astype(object)
        self.nodes: list[tuple] = []
        self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> int:
        points = self.entries[members]
        centre = points.sum(0) // len(members)
        far = max(self._squares(points, centre).tolist())
        at = len(self.nodes)
        self.nodes.append(())
        spread = points.max(0) - points.min(0)
        below = ()
        if len(members) > LEAF and spread.max() > 0:
            order = members[np.argsort(points[:, int(np.argmax(spread))], kind="stable")]
            below = self._node(order[: len(order) // 2]), self._node(order[len(order) // 2 :])
        self.nodes[at] = (centre, math.sqrt(far) * (1 + SLACK) if far < 1 << 1000 else math.inf, np.sort(members), below)
        return at

    @staticmethod
    def _squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
        d = points - centre
        return (d * d).sum(1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point the index of its nearest entry, the lowest of equals, and its squared distance."""
        if not (safe(points, points.shape[1]) and safe(self.entries, points.shape[1])):
            points = points.astype(object)
        best = self._squares(points, self.entries[0])
        index = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        self._down(0, points, rows, best, index)
        self._visit(0, points, rows, best, index)
        return index, best

    def _compare(self, members: np.ndarray, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        for e in members.tolist():
            d = self._squares(points[rows], self.entries[e])
            better = (d < best[rows]) | (d == best[rows]) & (e < index[rows])
            at = rows[better.astype(bool)]
            best[at], index[at] = d[better.astype(bool)], e

    def _down(self, node: int, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Each point meets the ball at the end of the way by nearer centres, for a first bound."""
        _, _, members, below = self.nodes[node]
        if not len(rows):
            return
        if not below:
            self._compare(members, points, rows, best, index)
            return
        left = (self._squares(points[rows], self.nodes[below[0]][0]) <= self._squares(points[rows], self.nodes[below[1]][0])).astype(bool)
        self._down(below[0], points, rows[left], best, index)
        self._down(below[1], points, rows[~left], best, index)

    def _visit(self, node: int, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        centre, radius, members, below = self.nodes[node]
        if points.dtype != object:
            bound = np.sqrt(self._squares(points[rows], centre).astype(float)) * (1 - SLACK) - radius
            rows = rows[(bound <= 0) | (bound * bound * (1 - SLACK) <= best[rows])]
        if not len(rows):
            return
        if not below:
            self._compare(members, points, rows, best, index)
        for child in below:
            self._visit(child, points, rows, best, index)


class Books:
    """The codebooks of all parts."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.balls = [Balls(x) for x in entries]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def assigned(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part: (its position, the vectors' parts, their entries, their squared distances)."""
        for p, balls in enumerate(self.balls):
            part = vectors[:, p * self.width : (p + 1) * self.width]
            yield p, part, *balls.nearest(part)

    def digest(self) -> str:
        flat = ",".join(str(x) for book in self.entries for entry in book.tolist() for x in entry)
        return hashlib.sha256(flat.encode()).hexdigest()


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, label) of the rows whose vector is not null and has finite components alone.

    Codes need vectors of one length that has equal parts: that of the smallest vec_id whose length has. Rows of other
    lengths are left out.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = v.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    even = finite.where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    first = even.select("vec_id", F.size("embedding").alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").first()
    return even.where(F.size("embedding") == (first["n"] if first else 0))


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as integers; those too large for int64 come by themselves."""
    for batch in batches:
        if batch.num_rows:
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            large = np.abs(values).max(1) >= 2.0**18
            for part in (~large, large):
                if part.any():
                    yield batch.filter(pa.array(part)), integers(values[part])


def _sums(books: Books, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: each entry's sums of components and, at position -1, its number of parts, in pieces."""
    totals = [np.zeros((len(x), books.width + 1), dtype=object) for x in books.entries]
    for _, vectors in _matrices(batches):
        for p, part, index, _ in books.assigned(vectors):
            sums = np.zeros(totals[p].shape, dtype=part.dtype)
            np.add.at(sums, index, np.concatenate([part, np.ones((len(part), 1), dtype=part.dtype)], axis=1))
            totals[p] += sums.astype(object)
    rows = []
    for p, total in enumerate(totals):
        for e in np.flatnonzero(total[:, -1]).tolist():
            for at, value in enumerate(total[e].tolist()):
                limb = 0
                while value >> LIMB not in (0, -1):
                    rows.append((p, e, at, limb, value & (1 << LIMB) - 1))
                    value, limb = value >> LIMB, limb + 1
                rows.append((p, e, at, limb, value))
    columns = [*zip(*rows, strict=True)] or [()] * 5
    names = ("part", "entry", "position", "limb", "value")
    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32() if n != "value" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def fitted(vectors: DataFrame, rounds: int = ROUNDS) -> Books | None:
    """The codebooks of what ``kept`` returns; None where it has no rows.

    They start as the parts of the ENTRIES smallest vec_ids (nulls last, ties by the vectors). In each round tasks assign
    their rows and send no more than the sums of each entry, which Spark adds up; their number does not grow with the rows.
    """
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    if not seeds:
        return None
    start = integers(np.array([r["embedding"] for r in seeds], dtype=float))
    width = start.shape[1] // PARTS
    books = Books([start[:, p * width : (p + 1) * width] for p in range(PARTS)])
    spark = vectors.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        partial = vectors.select("embedding").mapInArrow(lambda it, shared=shared: given_back(_sums(shared.value, it)), "part int, entry int, position int, limb int, value long")
        found = partial.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect()
        sums = [np.zeros((len(x), width + 1), dtype=object) for x in books.entries]
        for r in found:
            sums[r["part"]][r["entry"], r["position"]] += r["value"] << LIMB * r["limb"]
        books = Books([_moved(x, s) for x, s in zip(books.entries, sums, strict=True)])
    return books


def _moved(entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
    new = entries.astype(object)
    for e in np.flatnonzero(sums[:, -1]).tolist():
        new[e] = sums[e, :-1] // sums[e, -1]
    return new.astype(np.int64) if max(map(abs, new.ravel().tolist()), default=0) < 1 << 62 else new


def _codes(books: Books, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, vectors in _matrices(batches):
        digits = np.zeros((len(vectors), PARTS), dtype=np.uint8)
        error = np.zeros(len(vectors), dtype=object)
        for p, _, index, far in books.assigned(vectors):
            digits[:, p] = index
            error = error + far.astype(object)
        code = [x.tobytes().hex() for x in digits]
        fits = [x if x < 1 << 63 else None for x in error.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(fits, type=pa.int64())], ["vec_id", "label", "code", "error"])


def encoded(vectors: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error) of what ``kept`` returns. An error that is too large for a long is null."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(lambda it: given_back(_codes(shared.value, it)), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decoded(codes: DataFrame, books: Books) -> DataFrame:
    """Adds ``approximation`` (array<double>) to ``codes`` (code, ...): the entries that a code names, as components."""
    table = literal([(x / SCALE).astype(float).tolist() for x in books.entries], "array<array<array<double>>>")
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximation", F.flatten(F.array(*(F.get(F.get(table, F.lit(p)), entry(p)) for p in range(PARTS)))))


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label; other columns are not read).

    Rows whose vector is null or holds null or non-finite components are left out (see ``kept`` for lengths). Repeated rows
    and null vec_ids are coded like others. label_error is the error summed over the rows with an equal label, nulls
    together; null if it is too large for a long. An empty table has an empty result.
    """
    rows = kept(vectors)
    books = fitted(rows)
    spark, kinds = vectors.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema}
    if books is None:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    coded = Stored(encoded(rows, books), "vector-codes").df
    sums = Stored(coded.groupBy(F.col("label").alias("of")).agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error")), "label-errors").df
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        # A label may hold a third of the rows: its sum is copied, and its rows are dealt to the copies.
        copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = coded.withColumn("dealt", F.pmod(F.xxhash64("vec_id", "code"), SALTS).cast("int"))
        both = dealt.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("dealt") == F.col("salt")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
