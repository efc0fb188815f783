"""Approximate nearest neighbours by collision counting over sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .caps import unit, usable

#: Neighbours of a query, and the queries' share of the ids, as the contract of op7 sets them.
NEAREST, EVERY = 5, 50
#: Vectors of a segment, and queries that are asked of it together.
SEGMENT, ASKED = 8192, 4096
#: Projections, the share of them in which a vector must collide with the query, the width of the first windows (in
#: standard deviations of a projection), and by how much each round widens them.
PROJECTIONS, COLLIDES, NARROWEST, WIDER = 64, 0.5, 0.5, 1.4
#: How sure it must be that a vector as near as the last one kept has been met before the windows stop widening.
SURE = 0.7
SEED = 78


def directions(dim: int) -> np.ndarray:
    """Random directions, in sets of mutually orthogonal ones."""
    rng = np.random.default_rng([SEED, dim])
    sets = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(math.ceil(PROJECTIONS / dim))]
    return np.concatenate(sets, axis=1)[:, :PROJECTIONS]


class Segment:
    """An index of some vectors: for each projection their values in order, and whose they are."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.unit = ids, unit(vectors)
        self.vectors, self.norms = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = directions(vectors.shape[1])
        values = (self.unit @ self.directions).T * math.sqrt(vectors.shape[1])
        self.order = np.argsort(values, axis=1, kind="stable")
        # All arrays as one: each lies above the one before it, as no value leaves -reach .. reach.
        self.reach = 2 * math.sqrt(vectors.shape[1])
        self.above = 3 * self.reach * np.arange(len(values))
        self.values = (np.take_along_axis(values, self.order, axis=1) + self.above[:, None]).ravel()

    def nearest(self, own_id: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(cosine, id) of up to k neighbours found, nearest first.

        The windows around the query's projections widen by rounds. Each vector that a window takes in collides once
        more; one that collides in enough projections is verified, none is left out. It ends when a vector as near as
        the k-th so far would have been met, or when all are.
        """
        n, m = self.order.shape[1], len(self.order)
        norm = math.sqrt(float((query * query).sum()))
        at = (unit(query[None]) @ self.directions)[0] * math.sqrt(len(query))
        lo = hi = self._places(at)
        hits, done = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        done[self.ids == own_id] = True
        needed, width = math.ceil(COLLIDES * m), NARROWEST
        best: list[tuple[float, int]] = []
        normal, sure = NormalDist(), NormalDist().inv_cdf(SURE)
        while True:
            low, high = np.minimum(self._places(at - width), lo), np.maximum(self._places(at + width), hi)
            taken = [x for of, a, b, c, d in zip(self.order, low.tolist(), lo.tolist(), hi.tolist(), high.tolist(), strict=True) for x in (of[a:b], of[c:d])]
            hits += np.bincount(np.concatenate(taken), minlength=n)
            lo, hi = low, high
            new = np.flatnonzero((hits >= needed) & ~done)
            if len(new):
                done[new] = True
                score = (self.vectors[new] * query).sum(axis=1) / (self.norms[new] * norm)
                order = np.lexsort((self.ids[new], -score))[:k]
                best = sorted([*best, *zip(score[order].tolist(), self.ids[new[order]].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
            if done.all() or (hi - lo).min() == n:
                return best
            if len(best) == k:
                far = math.sqrt(max(2 - 2 * best[-1][0], 1e-12))
                chance = 2 * normal.cdf(width / far) - 1
                if chance * m - sure * math.sqrt(m * chance * (1 - chance)) >= needed:
                    return best
            width *= WIDER

    def _places(self, at: np.ndarray) -> np.ndarray:
        """In each projection's array, how many values are below."""
        inside = np.clip(at, -self.reach, self.reach) + self.above
        return np.searchsorted(self.values, inside) - np.arange(len(at)) * self.order.shape[1]


def _ask(key, t):
    """Of one segment's vectors and the queries asked of it: each query's nearest there."""
    asks = t["ask"].to_numpy(zero_copy_only=False)
    ids = t["vec_id"].to_numpy()
    lists = t["embedding"].combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    out: list[tuple] = []
    if (~asks).any():
        index = Segment(ids[~asks], x[~asks])
        for q in np.flatnonzero(asks):
            out.extend((int(ids[q]), i, s) for s, i in index.nearest(int(ids[q]), x[q], NEAREST))
    columns = [*zip(*out, strict=True)] if out else [[], [], []]
    return pa.table([pa.array(c, type=k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def neighbours(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding; no others are read) whose vec_id is
    divisible by ``every``, the 5 nearest of all the others by cosine, nearest first, ties to the smaller vec_id.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows without a
    vec_id; a query's candidates are the vectors of its length. Rows that share a vec_id are one candidate each, and one
    query together: that of the shortest vector, among those the smallest by components. The index is a number of segments of about 8192 vectors, each with its sorted projections; queries
    are asked of every segment in blocks, and each segment answers with its own nearest few, so no task sees more than a
    segment and a block of queries.
    """
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))
    least = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("least"))
    asked = least.select("vec_id", "least.embedding", "least.dim")
    n = rows.count()
    segments, blocks = max(1, math.ceil(n / SEGMENT)), max(1, math.ceil(n / every / ASKED))
    part = lambda k, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(k)).cast("int")
    index = rows.withColumn("segment", part(segments, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("ask", F.lit(False))
    asks = asked.withColumn("block", part(blocks, 2)).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))).withColumn("ask", F.lit(True))
    found = index.unionByName(asks).groupBy("dim", "segment", "block").applyInArrow(_ask, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")
