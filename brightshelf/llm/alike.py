"""Near-duplicates by the similarity of five-word shingles: SimHash fingerprints and MinHash bands propose groups, the shingles
themselves decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, document_batches, given_back, local_components, split_hot, stored
from .simhash import fingerprint, first_of_each, shingle_hashes

#: Words of a shingle, and the Jaccard similarity (5 and 4: at least 4 / 5) from which texts are linked.
SHINGLE, OF, LEAST = 5, 5, 4
#: A pair at the least similarity meets in no band with a probability of (1 - 0.8 ** ROWS) ** BANDS, 1.6e-5; at 0.9 below 1e-14.
BANDS, ROWS = 60, 8
#: Texts of one proposed group: beyond this they are dealt to several tasks.
HOT = 256
#: Shingles that are hashed, and columns of shared shingles that are multiplied, at a time.
AT_ONCE, COLUMNS = 512, 8192
SEED = 19

_rng = np.random.default_rng(SEED)
_flip, _odd = _rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
_odd |= np.uint32(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def bands(shingles: np.ndarray) -> list[int]:
    """A hash of each band's MinHashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for a in range(0, len(x), AT_ONCE):
        np.minimum(low, ((x[a : a + AT_ONCE] ^ _flip) * _odd).min(axis=1), out=low)
    each = low.tobytes()
    return [xxhash.xxh64_intdigest(each[4 * ROWS * k : 4 * ROWS * (k + 1)], k) for k in range(BANDS)]


def _key(shingles: np.ndarray) -> int:
    """Names a set of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _prints(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, prints, found = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            keys.append(_key(s))
            prints.append(fingerprint(text.as_py()))
            found += bands(s)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), _longs(found))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _longs(keys), _longs(prints), batch.column("__same"), lists], ["doc_id", "fp", "print", "__same", "bands"])


def _stars(batches) -> Iterator[pa.RecordBatch]:
    """Of rows (band, fp) sorted by band: each fp with the first of its band."""
    band = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b, fp = batch.column("band").to_numpy(), batch.column("fp").to_numpy()
        new = np.append(b[0] != band, b[1:] != b[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
        lead = np.where(start >= 0, fp[start], 0 if first is None else first)
        apart = fp != lead
        band, first = b[-1], lead[-1]
        links = np.unique(np.stack([fp[apart], lead[apart]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["a", "b"])


def _sets(batches) -> Iterator[pa.RecordBatch]:
    """(fp, shingles) of (fp, text), once for each fp of a task."""
    seen = set()
    for batch in batches:
        keys, sets = [], []
        for fp, text in zip(batch.column("fp").to_pylist(), batch.column("text"), strict=True):
            if fp not in seen:
                seen.add(fp)
                keys.append(fp)
                sets.append(shingle_set(text.as_py()).view(np.int64))
        ends = np.cumsum([0, *map(len, sets)])
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["fp", "shingles"])


def alike(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each two of n sets whether they are similar enough; set k is flat[ends[k]:ends[k + 1]], without repeats."""
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    # A shingle of one set alone is in no intersection.
    shared = n > 1
    column = (np.cumsum(shared) - 1)[at]
    row, column = row[shared[at]], column[shared[at]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(size), len(size)), dtype=np.float32)
    for a in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, (a, a + COLUMNS))
        held = np.zeros((len(size), COLUMNS), dtype=np.float32)
        held[row[i:j], column[i:j] - a] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    return OF * both >= LEAST * (size[:, None] + size[None, :] - both)


_KEY = ["component", "part_i", "part_j"]


def _verify(batches) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: links that join all texts of a group that are linked, one per joined row."""

    def links(t: pa.Table) -> pa.RecordBatch:
        fp, side = t["fp"].to_numpy(), t["side"].to_numpy()
        lists = t["shingles"].combine_chunks()
        near = alike(lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy())))
        if t["part_i"][0].as_py() != t["part_j"][0].as_py():
            near &= side[:, None] != side[None, :]
        label = local_components(len(fp), *np.nonzero(np.triu(near, 1)))
        moved = label != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in _KEY]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c, k in zip(_KEY, keys, strict=True):
            new[1:] |= k[1:] != k[:-1]
            new[0] |= bool(held) and held[-1].column(c)[0].as_py() != k[0]
        at = 0
        for cut in [*np.flatnonzero(new).tolist(), None]:
            part = batch.slice(at) if cut is None else batch.slice(at, cut - at)
            if part.num_rows:
                held.append(part)
            if cut is not None:
                if held:
                    yield links(pa.Table.from_batches(held))
                held, at = [], cut
    if held:
        yield links(pa.Table.from_batches(held))


def _printed(prints: DataFrame) -> DataFrame:
    """(a, b): links that join the sets of ``prints`` (fp, print, ...) whose fingerprints the join of tries links.

    A fingerprint stands for its smallest set. The links go into the components of all proposals, with those of the bands,
    so that the driver plans their rounds once.
    """
    # Sets are what documents are there.
    named = stored(prints.select(F.col("fp").alias("doc_id"), F.col("print").alias("fp")).distinct(), "named-prints")
    reps = simhash.representatives(named)
    equal = named.join(reps, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    of = lambda c: reps.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep"))
    near = simhash.links(reps).distinct().join(of("a"), "a").join(of("b"), "b")
    return equal.unionByName(near.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest doc_id, with all its columns.

    Documents are linked where the Jaccard similarity of their sets of five-word shingles is 0.8 or more, and those of
    equal sets always; a group is all that is reachable. Texts of fewer than five words are one shingle, null and blank
    ones have none and are equal. Of rows that share the smallest doc_id the one of the smallest text stays. Where no
    row of a group has an id, one of them stays; where some has, rows without an id go.

    Equal sets are one node. Texts whose SimHash fingerprints link by op2's join of tries (simhash.links), and texts that
    share a band of MinHashes, as fingerprints alone reach about 1 % of the pairs at 0.8, are joined to proposed groups by
    stars, so their number is that of the rows; then each text's shingles go to its group once and every two of a group are compared.
    Groups beyond a bound are dealt to several tasks.
    """
    marked = document_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("__same"))
    of = marked.schema["doc_id"].dataType.simpleString()
    found = marked.mapInArrow(lambda it: given_back(_prints(it)), f"doc_id {of}, fp long, print long, __same long, bands array<long>")
    prints = stored(found, "shingle-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "__same")).alias("at"), F.max("bands").alias("bands")), "shingle-sets")
    banded = nodes.select("fp", F.explode("bands").alias("band")).repartition("band").sortWithinPartitions("band")
    stars = banded.mapInArrow(lambda it: given_back(_stars(it)), "a long, b long")
    groups = stored(components(stars.unionByName(_printed(prints))), "proposed")
    texts = nodes.join(groups, F.col("fp") == F.col("node"), "left_semi").select("fp", F.col("at.doc_id").alias("id"), F.col("at.__same").alias("same"))
    # Shuffled at every size: whether the chosen ones are few enough to broadcast would depend on the input.
    texts = marked.join(stored(texts, "chosen").hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__same") == F.col("same"))).select("fp", "text")
    sets = stored(texts.mapInArrow(lambda it: given_back(_sets(it)), "fp long, shingles array<long>"), "shingles")
    dealt = split_hot(groups.withColumnRenamed("node", "fp"), ["component"], "fp", HOT)
    dealt = dealt.join(sets, "fp").select(*_KEY, "side", "fp", "shingles").repartition(*_KEY).sortWithinPartitions(*_KEY)
    linked = components(dealt.mapInArrow(lambda it: given_back(_verify(it)), "a long, b long"))
    clusters = stored(nodes.select("fp", "rep").join(linked, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("cluster")), "clusters")
    least = clusters.groupBy("cluster").agg(F.min("rep").alias("component_id"))
    return first_of_each(docs, prints, stored(clusters.join(least, "cluster").select("fp", "component_id", "cluster"), "groups"))
