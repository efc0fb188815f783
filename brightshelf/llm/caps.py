"""Embedding near-duplicates by spherical-cap filters from structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_small, components, given_back, local_components, stored

#: Linked from this cosine on, as the contract of op3 sets it.
LEAST = 0.93
#: A filter is to hold about this many vectors of the largest label, and one linked pair in so many may share none.
HELD, MISSED = 1024, 1e-6
#: Blocks of a product code, and the share of a label that a filter holds at most.
CODE_BLOCKS, WIDEST = 2, 0.25
#: Filters of one code that a vector passes about (more of them depend on each other), and the share of linked pairs that a
#: code may miss at most; codes, and pairs of vectors for each, by which that is measured.
PASSED, WORST, DRAWN, PROBES = 1, 0.95, 12, 500
#: Vectors of one label and filter: beyond this they are dealt to several tasks.
HOT = 2048
SEED = 77


def plan(largest: int, dim: int) -> tuple[float, int, int] | None:
    """(height, directions, codes): how high a vector must exceed a direction (times the root of dim), directions of a code, codes.

    All is measured on codes as they are drawn, for vectors of this length: the height at which a filter holds its share,
    and how often a pair at the least linked cosine has no common filter in one code. Codes are rotated independently, so
    pairs miss each of them with that chance whatever the others do; there are as many as MISSED asks for, with the
    measured chance three standard errors up. None if no share of up to WIDEST does: then all is compared.
    """
    rng = np.random.default_rng([SEED, dim, 1])
    x = unit(rng.normal(size=(DRAWN * PROBES, dim)))
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    if dim < 2:
        return None
    y = LEAST * x + math.sqrt(1 - LEAST**2) * unit(y)
    share = min(WIDEST, HELD / max(largest, 1))
    while share <= WIDEST:
        directions = math.ceil(PASSED / share)
        codes = [Code(dim, directions, k) for k in range(DRAWN)]
        height = float(np.mean([np.quantile(c.heights(x[:100]), 1 - share) for c in codes]))
        met = 0
        for k, code in enumerate(codes):
            (i, of), (j, other) = (code.decode(v[k * PROBES : (k + 1) * PROBES], height) for v in (x, y))
            both = np.intersect1d(i * code.words**CODE_BLOCKS + of, j * code.words**CODE_BLOCKS + other)
            met += len(np.unique(both // code.words**CODE_BLOCKS))
        miss = 1 - met / len(x)
        miss += 3 * math.sqrt(max(miss * (1 - miss), 1 / len(x)) / len(x))
        if miss <= WORST:
            return height, directions, math.ceil(math.log(MISSED) / math.log(miss))
        share *= 2
    return None


class Code:
    """Directions that are sums of one random unit vector per block of rotated coordinates, scaled to length 1."""

    def __init__(self, dim: int, directions: int, number: int = 0):
        rng = np.random.default_rng([SEED, dim, number])
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = [round(dim * k / CODE_BLOCKS) for k in range(CODE_BLOCKS + 1)]
        self.words = math.ceil(directions ** (1 / CODE_BLOCKS))
        blocks = [rng.normal(size=(self.words, max(b - a, 1))) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.blocks = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in blocks]

    def heights(self, x: np.ndarray) -> np.ndarray:
        """How high each row of x exceeds each direction."""
        y = x @ self.rotation
        total = np.zeros((len(x), 1))
        for a, b, w in zip(self.cuts[:-1], self.cuts[1:], self.blocks, strict=True):
            total = (total[:, :, None] + (y[:, a:b] @ w.T)[:, None, :]).reshape(len(x), -1)
        return total * math.sqrt(x.shape[1] / CODE_BLOCKS)

    def decode(self, x: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of every direction that a unit row of x exceeds: words are added block by block, and what
        cannot get there with the best words of the blocks to come is dropped."""
        y = x @ self.rotation
        least = height / math.sqrt(x.shape[1]) * math.sqrt(CODE_BLOCKS)
        scores = [y[:, a:b] @ w.T if b > a else np.zeros((len(x), self.words)) for a, b, w in zip(self.cuts[:-1], self.cuts[1:], self.blocks, strict=True)]
        best = [s.max(axis=1) for s in scores]
        row, code, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for k, s in enumerate(scores):
            to_come = sum((b[row] for b in best[k + 1 :]), np.zeros(len(row)))
            at, word = np.nonzero(s[row] + (total + to_come)[:, None] >= least)
            row, code, total = row[at], code[at] * self.words + word, total[at] + s[row[at], word]
        return row, code


def usable(embedding: str = "embedding") -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    return F.coalesce(
        (F.size(embedding) > 0) & F.forall(embedding, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(embedding, lambda v: v != 0), F.lit(False)
    )


def _filters(plans: dict[int, tuple[float, int, int]], batches) -> Iterator[pa.RecordBatch]:
    """Each vector (rep, label, embedding) once for each filter that it passes, with those of its filters before that."""
    codes: dict[int, list[Code]] = {}
    for batch in batches:
        lengths = np.diff(batch.column("embedding").offsets.to_numpy())
        for dim in map(int, np.unique(lengths)):
            rows = batch.take(pa.array(np.flatnonzero(lengths == dim)))
            x = unit(_matrix(rows.column("embedding"), dim))
            height, directions, n = plans[dim]
            if dim not in codes:
                codes[dim] = [Code(dim, directions, k) for k in range(n)]
            found = [(row, k * code.words**CODE_BLOCKS + of) for k, code in enumerate(codes[dim]) for row, of in [code.decode(x, height)]]
            row, of = (np.concatenate(p) for p in zip(*found, strict=True))
            order = np.lexsort((of, row))
            row, of = row[order], of[order].astype(np.int32)
            start = np.searchsorted(row, row)
            before = pa.array([of[a:b] for a, b in zip(start.tolist(), range(len(of)), strict=True)], type=pa.list_(pa.int32()))
            picked = rows.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(of, type=pa.int64()), before], [*picked.schema.names, "filter", "filters"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_KEY = ["label", "dim", "filter", "part_i", "part_j"]


def _verify(batches) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and side: how many vectors each is linked with, and links that join all that is linked.

    A pair that meets in several filters counts in the smallest of them alone.
    """

    def groups():
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = [t[c].to_numpy() for c in _KEY]
            cut = np.zeros(t.num_rows, dtype=bool)
            for k in keys:
                cut[1:] |= k[1:] != k[:-1]
            start = np.flatnonzero(cut)
            for a, b in zip([0, *start[:-1]], start, strict=True) if len(start) else ():
                yield t.slice(a, b - a)
            held = t.slice(start[-1] if len(start) else 0).combine_chunks().to_batches()
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    out: list[tuple] = []
    for t in groups():
        if t.num_rows < 2:
            continue
        reps, copies, side = t["rep"].to_numpy(), t["copies"].to_numpy(), t["side"].to_numpy()
        x = unit(_matrix(t["embedding"].combine_chunks(), t["dim"][0].as_py()))
        if t["part_i"][0].as_py() == t["part_j"][0].as_py():
            i, j = np.nonzero(np.triu(x @ x.T >= LEAST - 1e-9, 1))
        else:
            first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            i, j = np.nonzero(x[first] @ x[second].T >= LEAST - 1e-9)
            i, j = first[i], second[j]
        exact = (x[i] * x[j]).sum(axis=1) >= LEAST
        i, j = i[exact], j[exact]
        if not len(i):
            continue
        filters = t["filters"].combine_chunks()
        # Filters before this one that some of the rows pass, numbered anew.
        own, flat = np.unique(filters.flatten().to_numpy(), return_inverse=True)
        member = np.zeros((t.num_rows, len(own)), dtype=bool)
        member[np.repeat(np.arange(t.num_rows), np.diff(filters.offsets.to_numpy())), flat] = True
        new = ~_any_common(member, i, j)
        linked = np.bincount(i[new], copies[j[new]], t.num_rows) + np.bincount(j[new], copies[i[new]], t.num_rows)
        label = local_components(t.num_rows, i, j)
        for k in np.flatnonzero((linked > 0) | (label != np.arange(t.num_rows))):
            out.append((int(reps[k]), int(reps[label[k]]), int(linked[k])))
        if len(out) > 5000:
            yield _links(out)
            out = []
    if out:
        yield _links(out)


def _any_common(member: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    packed = np.packbits(member, axis=1)
    out = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), 20_000):
        out[a : a + 20_000] = (packed[i[a : a + 20_000]] & packed[j[a : a + 20_000]]).any(axis=1)
    return out


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "links"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label; no others are read).

    Vectors of one label are linked from cosine 0.93 on, in double precision; vectors of different lengths never. Vectors
    that are null, empty or zero, hold null or non-finite components, or have no label link with nothing. A row without a
    vec_id is linked and counted, but names no component; if none of a group has an id, component_id is null and kept
    false. Rows that share a vec_id are vectors of their own with the same id.

    Equal vectors of a label are one node with a number of copies. Each node goes to the filters that it exceeds, in labels
    of any size, and a pair is compared where both go. Filters that too many share are dealt to several tasks. A task returns
    counts and a spanning forest, never pairs. What is not found is a linked pair without a common filter: about one in a
    million at cosine 0.93, less often above. Vectors of a length that no code separates are compared each with each.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    fit = rows.where(usable() & F.col("label").isNotNull()).groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # A node's number has nothing to do with its rows' ids, which may be null or those of other nodes too.
    nodes = stored(fit.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "vectors")
    large = stored(nodes.groupBy("label", "dim").count(), "labels")
    plans = {r["dim"]: plan(r["largest"], r["dim"]) for r in large.groupBy("dim").agg(F.max("count").alias("largest")).collect()}
    plans = {dim: found for dim, found in plans.items() if found}
    vector = nodes.drop("least").withColumnRenamed("node", "rep")
    compared = {"filter": F.lit(-1).cast("long"), "filters": F.array().cast("array<int>")}
    passed = vector.withColumns(compared)
    if plans:
        coded = large.where(F.col("dim").isin(*plans)).select("label", "dim", F.lit(True).alias("coded"))
        marked = attach_small(vector, coded, ["label", "dim"]).select(*vector.columns, F.coalesce("coded", F.lit(False)).alias("coded"))
        schema = vector.schema.simpleString()[7:-1].replace(":", " ") + ", filter long, filters array<int>"
        filtered = marked.where("coded").drop("coded").mapInArrow(lambda it: given_back(_filters(plans, it)), schema)
        whole = marked.where("not coded").drop("coded").withColumns(compared)
        passed = whole.unionByName(filtered)
    sizes = stored(passed.groupBy("label", "dim", "filter").count().where(f"count > {HOT}"), "hot-filters")
    chunks = attach_small(passed, sizes.select("label", "dim", "filter", F.ceil(F.col("count") / HOT).cast("int").alias("s")), ["label", "dim", "filter"])
    chunks = chunks.withColumns({"s": F.coalesce("s", F.lit(1)), "own": F.pmod(F.xxhash64("rep"), F.coalesce("s", F.lit(1))).cast("int")})
    dealt = chunks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumns(
        {"part_i": F.least("own", "other"), "part_j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}
    )
    dealt = dealt.drop("s", "own", "other").repartition(*_KEY).sortWithinPartitions(*_KEY, "side", "rep")
    found = stored(dealt.mapInArrow(lambda it: given_back(_verify(it)), "a long, b long, links long"), "cap-links")
    counts = found.groupBy("a").agg(F.sum("links").alias("others"))
    comps = components(found.select("a", "b"))
    lowest = stored(comps.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("lowest")), "components")
    per_node = (
        nodes.select("label", "embedding", "copies", "node", "least")
        .join(counts, F.col("node") == F.col("a"), "left")
        .join(attach_small(comps, lowest, ["component"]), "node", "left")
        .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id"))
    )
    out = rows.withColumn("fits", usable()).withColumn("key", F.when(F.col("fits"), F.col("embedding")))
    out = out.join(per_node.withColumnRenamed("embedding", "key"), ["label", "key"], "left")
    linked = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), linked.alias("component_id"), F.coalesce(linked == F.col("vec_id"), F.lit(False)).alias("kept"))
