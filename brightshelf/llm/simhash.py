"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_small, components, document_batches, free_name, given_back, local_components, stored

BITS, SEED = 64, 42
#: Words of a shingle and differing bits of a link, as the contract of op2 sets them.
SHINGLE, BUDGET = 3, 3
#: Of 3 differing bits at most 1 lies in one of the halves. So there are two tries, one of the fingerprints and one of them
#: with their halves exchanged, and down to the middle of each a pair of paths may differ in FIRST_HALF bits only.
HALF, FIRST_HALF = 32, 1
#: Fingerprints below one node of the depth at which tries are dealt to tasks, and those beyond which it is dealt to several.
BELOW, HOT = 16, 1024
#: Pairs of leaves below the node pairs that are traversed at a time.
AT_ONCE = 2_000_000

_byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_byte_row = np.arange(8) * 256
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The hash of each shingle of a text, in their order; A-Z are lower-cased. Fewer words than ``width`` are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(_hash, shingles), dtype="<u8", count=max(1, len(words) - width + 1))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; null and blank texts have 0.

    A-Z are lower-cased. Texts of fewer words than ``width`` are one shingle. Repeated shingles count each time.
    """
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if not n:
        return 0
    tally = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _byte_row).ravel(), minlength=2048).reshape(8, 256)
    bits = (tally @ _byte_bits).ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))


def fingerprint_of(text: str) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


def _exchanged(fp: Column) -> Column:
    return F.shiftleft(fp, HALF).bitwiseOR(F.shiftrightunsigned(fp, HALF))


def trie_pairs(rest: np.ndarray, lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, diff: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of ``rest`` from the given pairs of trie nodes that differ in at most BUDGET bits, FIRST_HALF of them above HALF.

    A node is a sorted range of ``rest``; the paths of each pair of nodes, all but the low ``bits`` bits, differ in ``diff``
    bits. The pairs go down together, bit by bit: a pair of nodes becomes up to four pairs of their children, with one more
    differing bit where the children are unlike, and goes no further once the budget is exceeded. Below a node of one
    fingerprint the path does not branch, so two of them are compared by all their bits at once. A node paired with
    itself yields each unordered pair once.
    """
    found_a, found_b = [], []
    for bit in range(bits - 1, -2, -1):
        leaf = (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
        i, j = lo_a[leaf], lo_b[leaf]
        near = (i != j) & (np.bitwise_count(rest[i] ^ rest[j]) <= BUDGET)
        found_a.append(i[near])
        found_b.append(j[near])
        lo_a, hi_a, lo_b, hi_b, diff = (x[~leaf] for x in (lo_a, hi_a, lo_b, hi_b, diff))
        if bit < 0 or not len(lo_a):
            break
        zeros = np.concatenate(([0], np.cumsum(1 - ((rest >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))))
        mid_a, mid_b = lo_a + zeros[hi_a] - zeros[lo_a], lo_b + zeros[hi_b] - zeros[lo_b]
        own = lo_a == lo_b
        parts = [
            (lo_a, mid_a, lo_b, mid_b, diff),
            (mid_a, hi_a, mid_b, hi_b, diff),
            (lo_a, mid_a, mid_b, hi_b, diff + 1),
            tuple(x[~own] for x in (mid_a, hi_a, lo_b, mid_b, diff + 1)),
        ]
        lo_a, hi_a, lo_b, hi_b, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        go = (lo_a < hi_a) & (lo_b < hi_b) & (diff <= (FIRST_HALF if bit >= HALF else BUDGET))
        lo_a, hi_a, lo_b, hi_b, diff = (x[go] for x in (lo_a, hi_a, lo_b, hi_b, diff))
    return np.concatenate(found_a), np.concatenate(found_b)


#: What names a pair of trie nodes at the depth of the exchange, and the chunks of them that meet in a task.
_KEY = ["trie", "bit", "base", "part_i", "part_j"]


def _join_tries(depth: int, batches):
    """Of rows (_KEY, side, path) sorted by all of them: links that join all that is linked, one per joined row."""
    held: list[pa.RecordBatch] = []

    def links(t: pa.Table):
        columns = [t[c].to_numpy() for c in _KEY]
        side, path = t["side"].to_numpy(), t["path"].to_numpy().view(np.uint64)
        new = np.zeros(len(path), dtype=bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(path))
        ones = np.concatenate(([0], np.cumsum(side == 1)))
        mid = end - (ones[end] - ones[start])
        trie, bit, _, part_i, part_j = (c[start] for c in columns)
        own = (bit < 0) & (part_i == part_j)
        lo_a, hi_a, lo_b, hi_b = start, np.where(own, end, mid), np.where(own, start, mid), end
        some = (lo_a < hi_a) & (lo_b < hi_b) & (~own | (end - start > 1))
        lo_a, hi_a, lo_b, hi_b, bit, trie = (x[some] for x in (lo_a, hi_a, lo_b, hi_b, bit, trie))
        work = np.cumsum((hi_a - lo_a) * (hi_b - lo_b))
        for chunk in np.split(np.arange(len(work)), np.flatnonzero(np.diff(work // AT_ONCE)) + 1):
            if not len(chunk):
                continue
            low, high = lo_a[chunk].min(), hi_b[chunk].max()
            i, j = trie_pairs(path[low:high], *(x[chunk] - low for x in (lo_a, hi_a, lo_b, hi_b)), (bit[chunk] >= 0).astype(np.int64), BITS - depth)
            nodes, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            label = local_components(len(nodes), at[: len(i)], at[len(i) :])
            moved = label != np.arange(len(nodes))
            swapped = columns[0][low:high] == 1
            fp = np.where(swapped, (path[low:high] << np.uint64(HALF)) | (path[low:high] >> np.uint64(HALF)), path[low:high]).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": fp[nodes[moved]], "b": fp[nodes[label[moved]]]})

    def last_key(batch):
        return tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in _KEY)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*held, batch])
        inside = np.ones(t.num_rows, dtype=bool)
        for c, v in zip(_KEY, last_key(batch), strict=True):
            inside &= t[c].to_numpy() == v
        cut = t.num_rows - int(inside.sum())
        if cut:
            yield from links(t.slice(0, cut).combine_chunks())
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield from links(pa.Table.from_batches(held))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    Fingerprints link at 3 or fewer differing bits, and equal ones always. component_id is the smallest doc_id reachable.
    Null and blank texts have fingerprint 0 and link like any other. A row whose doc_id is null gets its group's
    component_id (null if no other row of the group has an id). Rows that share a doc_id count as one document.

    Equal fingerprints are one leaf, whatever their number; so a group of copies costs one row. Two binary tries are joined
    with themselves: see FIRST_HALF. Down to a depth that leaves about BELOW fingerprints under a node, each pair of nodes
    within the budget is a key of the exchange: a fingerprint goes to its own node and to the pairs with those that are one
    bit away. Each task then traverses the pairs from there. Nodes with too much below them are dealt to several tasks. A
    task emits a spanning forest of what it finds, never all pairs.
    """
    prints = stored(document_batches(docs).select("doc_id", fingerprint_of("text").alias("fp")), "fingerprints")
    return prints.join(groups(prints), "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near_duplicates(): that of the smallest doc_id, with all its columns.

    Of rows that share that doc_id the one of the smallest text stays. Where no row of a group has an id, one of each
    fingerprint stays; where some has, rows without an id go.
    """
    # What tells rows without an id apart, here and below.
    same = F.xxhash64("text").alias("__same")
    prints = stored(document_batches(docs).select("doc_id", fingerprint_of("text").alias("fp"), same), "fingerprints")
    return first_of_each(docs, prints, stored(groups(prints).withColumn("cluster", F.col("fp")), "groups"))


def first_of_each(docs: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` that stays of each group of ``found`` (fp, component_id, cluster); ``prints`` (doc_id, fp, __same) are of ``docs``.

    It is that of component_id; where that is null, one row of the cluster.
    """
    roots = found.where("component_id is not null").select(F.col("component_id").alias("doc_id")).distinct()
    # Names that no column of the documents has.
    place, same = free_name(docs, "__first"), free_name(docs, "__same")
    known = docs.join(roots, "doc_id", "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(place) == 1)
    lone = prints.where("doc_id is null").join(found.where("component_id is null"), "fp").groupBy("cluster").agg(F.min("__same").alias(same)).select(same)
    nameless = docs.where("doc_id is null").withColumn(same, F.xxhash64("text")).join(lone, same, "left_semi")
    nameless = nameless.withColumn(place, F.row_number().over(Window.partitionBy(same).orderBy("text"))).where(F.col(place) == 1)
    return known.select(*docs.columns).unionByName(nameless.select(*docs.columns))


def _dealt(nodes: DataFrame, depth: int) -> DataFrame:
    """Rows (_KEY, side, path) for each pair of trie nodes of this depth that a row of ``nodes`` (trie, path) belongs to."""
    top = F.shiftrightunsigned("path", BITS - depth)
    nodes = nodes.withColumn("top", top)
    sizes = stored(nodes.groupBy("trie", "top").count().where(F.col("count") > HOT), "hot-nodes")
    paired = nodes.withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(depth - 1))))
    mask = F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, greatest(bit, 0))"))
    paired = paired.withColumns({"other": F.col("top").bitwiseXOR(mask), "base": F.col("top").bitwiseAND(F.bitwise_not(mask))})
    side = (F.col("top") != F.col("base")).cast("int")
    zero = F.lit(0)
    if sizes.isEmpty():
        return paired.select("trie", "bit", "base", zero.alias("part_i"), zero.alias("part_j"), side.alias("side"), "path")
    chunks = sizes.select("trie", "top", F.ceil(F.col("count") / HOT).cast("int").alias("s"))
    paired = attach_small(paired, chunks, ["trie", "top"])
    paired = attach_small(paired, stored(chunks.withColumnsRenamed({"top": "other", "s": "other_s"}), "hot-others"), ["trie", "other"])
    paired = paired.withColumn("own", F.pmod(F.xxhash64("path"), F.coalesce("s", F.lit(1))).cast("int"))
    paired = paired.withColumn("chunk", F.explode(F.sequence(zero, F.coalesce("other_s", F.lit(1)) - 1)))
    # Of one node's chunks the smaller number is side 0; of two nodes, the one without the bit is.
    alone = F.col("bit") < 0
    first = F.when(alone, F.least("own", "chunk")).when(side == 0, F.col("own")).otherwise(F.col("chunk"))
    second = F.when(alone, F.greatest("own", "chunk")).when(side == 0, F.col("chunk")).otherwise(F.col("own"))
    return paired.select("trie", "bit", "base", first.alias("part_i"), second.alias("part_j"), F.when(alone, (F.col("own") > F.col("chunk")).cast("int")).otherwise(side).alias("side"), "path")


def representatives(prints: DataFrame) -> DataFrame:
    """(fp, rep): each distinct fp of ``prints`` (doc_id, fp) with its smallest doc_id; stored."""
    return stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")


def links(reps: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints of ``reps`` (fp, ...; distinct) that the join of tries links."""
    depth = min(HALF, max(1, math.ceil(math.log2(max(reps.count(), 1) / BELOW))))
    tries = reps.select(F.posexplode(F.array("fp", _exchanged(F.col("fp")))).alias("trie", "path"))
    order = [*_KEY, "side", "path"]
    dealt = _dealt(tries, depth).repartition(*_KEY).sortWithinPartitions(*order).select(*order)
    return dealt.mapInArrow(lambda it: given_back(_join_tries(depth, it)), "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fp of ``prints`` (doc_id, fp)."""
    reps = representatives(prints)
    found = stored(components(links(reps)), "linked")
    lowest = found.join(reps, found.node == reps.fp).groupBy("component").agg(F.min("rep").alias("lowest"))
    linked = found.join(lowest, "component").select(F.col("node").alias("fp"), "lowest")
    return reps.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "rep").alias("component_id"))
