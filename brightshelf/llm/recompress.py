"""Removal of passages that an earlier document holds, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import input_bytes

#: Words of a window, as the contract of op9 sets it.
WINDOW = 13
#: Blocks of documents and ranges of names for each shuffle partition: enough to deal them evenly.
BLOCKS_EACH, BUCKETS_EACH = 2, 1
#: Bytes of stored documents for each block at most, on the average.
BLOCK_BYTES = 64 << 20
#: Bytes of text that are parsed at a time, and bytes of a word from which it is hashed by itself.
AT_ONCE, LONG = 1_000_000, 256

#: What of a name of symbols is sent: names that differ in their low bits alone only cost a comparison of their windows.
_SENT = np.uint64(0xFFFF_FFFF_FFFF_0000)

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_rng = np.random.default_rng(20_240_913)
#: What a byte counts in the hash of its word; 0 for white space.
_of_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_blank = np.zeros(256, dtype=bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of many stretches of one sequence: sums of its values times powers of an odd number, and shifted back."""

    def __init__(self, base: int):
        self.base, self.inverse = (np.uint64(x) for x in (base, pow(base, -1, 1 << 64)))
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        while len(self.powers) <= len(values):
            n = np.uint64(len(self.powers))
            self.powers = np.concatenate((self.powers, self.powers * self.powers[-1] * self.base))
            self.inverses = np.concatenate((self.inverses, self.inverses * self.inverses[-1] * self.inverse))
            assert len(self.powers) == 2 * n
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.inverses[start])


#: Of the bytes of a word, of symbols, and of the words of a window; the last tells windows apart whose other names are equal by chance.
_bytes, _symbols, _first, _second = (Rolling(x) for x in (0x5DEECE66D9B1A3C7, 0x1F83D9ABFB41BD6B, 0x27BB2EE687B0B0FF, 0x369DEA0F31A53F87))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


class Words:
    """The words of many documents in a row: their hashes, their document, and where each window of theirs starts."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.data = data
        solid = ~_blank[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = solid[:-1]
        #: The bytes where each word starts and ends.
        self.begin = np.flatnonzero(solid & (edge[:-1] | ~before))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
        self.hash = _bytes.between(_bytes.sums(_of_byte[data]), self.begin, self.end) ^ (self.end - self.begin).astype(np.uint64) * _M3
        for k in np.flatnonzero(self.end - self.begin >= LONG):
            self.hash[k] = xxhash.xxh3_64_intdigest(data[self.begin[k] : self.end[k]].tobytes())
        #: The first word of each document, and the end of the last one.
        self.bounds = np.searchsorted(self.begin, offsets)
        self.lengths = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.starts, self.ends = self.bounds[:-1], self.bounds[1:]
        n = len(self.hash)
        #: The place of each window's first word.
        self.windows = np.flatnonzero(np.arange(n) + WINDOW <= self.ends[self.doc]) if n else np.zeros(0, np.int64)

    def window_names(self, at: np.ndarray, by: Rolling = _first) -> np.ndarray:
        """A 64-bit name of each window that starts at one of these places."""
        return by.between(by.sums(self.hash), at, at + WINDOW)

    def second_names(self, at: np.ndarray) -> np.ndarray:
        """32 bits more."""
        return (self.window_names(at, _second) >> np.uint64(32)).astype(np.uint32)

    def anchors(self) -> np.ndarray:
        """For each window the name of the symbols that stand for it.

        A run of one word becomes one symbol; then, in rounds, a symbol of the left half of the alphabet and a following one
        of the right half become one. Names are hashes of what they replace, so they agree wherever they are made. Beside
        each symbol stands the range of words on which its making depended, neighbours included. A symbol whose range lies
        within a window is made in every occurrence of that window; so those of the highest round that has any are the same in
        every occurrence. Beyond a document's ends lies one place that no window of its
        has, so a symbol that depends on an end stands for no window. Rounds go on until no symbol fits a window. A window
        within a run holds no whole symbol; it is one by itself.
        """
        at = self.windows
        best = self.window_names(at)
        if not len(at):
            return best
        name = _mix(self.hash)
        # Runs: a maximal run becomes one symbol. It, and a word that is no run, depend on the words on both sides.
        head = np.ones(len(name), dtype=bool)
        head[1:] = name[1:] != name[:-1]
        head[self.starts[self.lengths > 0]] = True
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(name)))
        low, high = first - 1, first + count
        name = np.where(count > 1, _mix(name[first] * _M3 + count.astype(np.uint64)), name[first])
        opens = np.zeros(len(head), dtype=bool)
        opens[self.starts[self.lengths > 0]] = True
        opens, first = opens[first], first
        level = 0
        while self._offer(best, at, name, low, high):
            level += 1
            salt = np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            left = (_mix(name ^ salt) & np.uint64(1)).astype(bool)
            joins = np.zeros(len(name), dtype=bool)
            joins[:-1] = left[:-1] & ~left[1:] & ~opens[1:]
            joined = np.zeros(len(name), dtype=bool)
            joined[1:] = joins[:-1]
            # A symbol that stays alone depends on the neighbour that it did not join.
            before, after = np.empty_like(low), np.empty_like(high)
            before[1:], after[:-1] = low[:-1], high[1:]
            before[0], after[-1] = -1, len(self.hash)
            before[opens] = first[opens] - 1
            closes = np.flatnonzero(opens[1:])
            after[closes] = first[closes + 1]
            alone = ~joins & ~joined
            low = np.where(alone & ~left, before, low)
            high = np.where(alone & left, after, high)
            keep = np.flatnonzero(~joined)
            mate = keep + joins[keep]
            name = np.where(joins[keep], _mix(name[keep] * _M2 + _mix(name[mate] + salt)), name[keep])
            low, high, first, opens = np.minimum(low[keep], low[mate]), np.maximum(high[keep], high[mate]), first[keep], opens[keep]
        return best & _SENT

    @staticmethod
    def _offer(best: np.ndarray, at: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
        """Each window that holds the range of a symbol of this round takes all of them; whether any did.

        Ranges are in order, by both their ends. So the first symbol is that which does not begin before the window, and the
        last that which does not end after it.
        """
        n = int(at[-1]) + WINDOW + 1
        begun, ended = (np.cumsum(np.bincount(np.minimum(x, n), minlength=n + 1)) for x in (low + 1, high))
        first, last = begun[at], ended[at + WINDOW - 1]
        fits = first < last
        best[fits] = _symbols.between(_symbols.sums(name), first[fits], last[fits])
        return bool(fits.any())


def _parsed(t: pa.Table) -> Iterator[tuple[slice, Words]]:
    """The documents of a block, some at a time."""
    texts = t["text"].fill_null("").combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE)))
        yield slice(begin, end), Words(texts.slice(begin, end - begin))
        begin = end


def _distinct(names: np.ndarray) -> np.ndarray:
    names = np.sort(names)
    keep = np.ones(len(names), dtype=bool)
    keep[1:] = names[1:] != names[:-1]
    return names[keep]


def _planes(values: np.ndarray) -> bytes:
    """First all lowest bytes, then all second ones, and so on: the high bytes of ids and of sorted names are alike, and the
    exchange compresses them."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _packed(block: int, names: np.ndarray, n: int, **more: np.ndarray) -> pa.Table:
    """One row for each of n ranges of names: the block's sorted names as bytes, with as many values of each further column."""
    cut = np.append(np.searchsorted(names, np.array([(k << 64) // n for k in range(n)], dtype=np.uint64)), len(names))
    full = np.flatnonzero(np.diff(cut))
    columns = {"bucket": pa.array(full, type=pa.int32()), "block": pa.array(np.full(len(full), block), type=pa.int32())}
    for column, values in {"names": names, **more}.items():
        columns[column] = pa.array([_planes(values[cut[k] : cut[k + 1]]) for k in full], type=pa.binary())
    return pa.table(columns)


def _id_order(t: pa.Table) -> np.ndarray:
    """doc_id as int64, nulls after all others."""
    ids = t["doc_id"].to_numpy(zero_copy_only=False) if not t["doc_id"].null_count else t["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    return ids.astype(np.int64)


def _in_order(names: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """An order of pairs of names. Equal first names nearly always have equal second ones, so one sort does."""
    order = np.argsort(names)
    n, m = names[order], seconds[order]
    return order if not ((n[1:] == n[:-1]) & (m[1:] != m[:-1])).any() else np.lexsort((seconds, names))


def _smallest(names: np.ndarray, seconds: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of names, sorted, and the smallest id of each."""
    if not len(names):
        return names, seconds, ids
    order = _in_order(names, seconds)
    names, seconds, ids = names[order], seconds[order], ids[order]
    start = np.flatnonzero(_changes(names, seconds))
    return names[start], seconds[start], np.minimum.reduceat(ids, start)


def _changes(names: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    first = np.ones(len(names), dtype=bool)
    first[1:] = (names[1:] != names[:-1]) | (seconds[1:] != seconds[:-1])
    return first


class Blocks:
    """``docs`` dealt to blocks by doc_id. Each pass reads the same exchange of texts, so they are shuffled once.

    Blocks and buckets follow the session's number of shuffle partitions, and there are no fewer blocks than the input has
    BLOCK_BYTES, so that a block fits a worker whatever that number is. What
    passes between blocks is packed: for a range of names, the block's distinct names as one binary value.
    """

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
            raise TypeError("doc_id must be of an integer type, as windows are kept by the smaller number")
        large = -(-input_bytes(docs) // BLOCK_BYTES)
        self.n_blocks, self.n_buckets = max(parts * BLOCKS_EACH, large), max(parts * BUCKETS_EACH, large)
        key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
        #: The block's column has a name that no column of the documents has.
        self.block = next(x for x in ("__block" + "_" * k for k in range(len(docs.columns) + 1)) if x not in docs.columns)
        self.docs = docs.withColumn(self.block, F.pmod(key, F.lit(self.n_blocks)).cast("int"))

    def shared_anchors(self) -> DataFrame:
        """(block, names): the anchors of each block that another block has too."""
        n = self.n_buckets

        def gather(key, t):
            found = []
            for _, words in _parsed(t):
                a = words.anchors()
                found.append(_distinct(a[np.append(True, a[1:] != a[:-1])]) if len(a) else a)
            names = _distinct(np.concatenate([np.zeros(0, np.uint64), *found]))
            return _packed(key[0].as_py(), names, n)

        def match(key, t):
            blocks, lists = t["block"].to_numpy(), _columns(t, "names", np.uint64)
            names = np.sort(np.concatenate(lists))
            again = np.zeros(len(names), dtype=bool)
            again[1:] = names[1:] == names[:-1]
            shared = _distinct(names[again])
            return _reply(blocks, names=[x[_isin_sorted(x, shared)] for x in lists])

        packed = self.docs.groupBy(self.block).applyInArrow(gather, "bucket int, block int, names binary")
        return packed.groupBy("bucket").applyInArrow(match, "block int, names binary")

    def repeated_windows(self, anchors: DataFrame) -> DataFrame:
        """(block, names): the windows of each block that start in another block's document of a smaller doc_id; both names of each."""
        n = self.n_buckets

        def gather(key, t, replies):
            if not t.num_rows:
                return _packed(0, np.zeros(0, np.uint64), n, seconds=np.zeros(0, np.uint32), ids=np.zeros(0, np.int64))
            ids, shared = _id_order(t), _names(replies)
            names, seconds, of = [], [], []
            for part, words in _parsed(t):
                anchor = words.anchors()
                at = words.windows[_isin_sorted(anchor, shared)]
                names.append(words.window_names(at))
                seconds.append(words.second_names(at))
                of.append(ids[part][words.doc[at]])
            found, second, least = _smallest(*map(np.concatenate, (names, seconds, of)))
            return _packed(key[0].as_py(), found, n, seconds=second, ids=least)

        def match(key, t):
            names, seconds, ids = (_columns(t, c, kind) for c, kind in (("names", np.uint64), ("seconds", np.uint32), ("ids", np.int64)))
            repeated = _repeated(*map(np.concatenate, (names, seconds, ids)))
            hits = np.split(repeated, np.cumsum([len(x) for x in names])[:-1])
            return _reply(t["block"].to_numpy(), names=[x[h] for x, h in zip(names, hits, strict=True)], seconds=[x[h] for x, h in zip(seconds, hits, strict=True)])

        left = self.docs.groupBy(self.block)
        packed = left.cogroup(anchors.groupBy("block")).applyInArrow(gather, "bucket int, block int, names binary, seconds binary, ids binary")
        return packed.groupBy("bucket").applyInArrow(match, "block int, names binary, seconds binary")

    def apply(self, windows: DataFrame, finish, schema: str) -> DataFrame:
        """Each block's documents (all columns) with what is removed of them, as ``finish(table, removed)`` returns it.

        ``removed`` has an array of booleans for each document, one for each of its words.
        """

        def remove(key, t, replies):
            ids, elsewhere = _id_order(t) if t.num_rows else np.zeros(0, np.int64), _pairs(replies)
            parts = [(part, w, w.window_names(w.windows)) for part, w in _parsed(t)] if t.num_rows else []
            names = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, np.uint64)
            of = np.concatenate([ids[p][w.doc[w.windows]] for p, w, _ in parts]) if parts else np.zeros(0, np.int64)
            # Second names are made where the first are met again, here or elsewhere.
            again = _isin_sorted(names, elsewhere[0]) | _met_again(names)
            seconds, begin = [], 0
            for _, words, own in parts:
                seconds.append(words.second_names(words.windows[again[begin : begin + len(own)]]))
                begin += len(own)
            names, seconds, of = names[again], np.concatenate([np.zeros(0, np.uint32), *seconds]), of[again]
            repeated = np.zeros(len(again), dtype=bool)
            repeated[again] = _repeated(names, seconds, of) | _pairs_in(names, seconds, *elsewhere)
            removed, begin = [], 0
            for _, words, own in parts:
                hit = repeated[begin : begin + len(own)]
                begin += len(own)
                edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
                at = words.windows[hit]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                covered = np.cumsum(edge[:-1]) > 0
                removed.extend(covered[a:b] for a, b in zip(words.starts, words.ends, strict=True))
            return finish(t, removed)

        return self.docs.groupBy(self.block).cogroup(windows.groupBy("block")).applyInArrow(remove, schema)


def _repeated(names: np.ndarray, seconds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each pair of names also stands beside a smaller id."""
    if not len(names):
        return np.zeros(0, dtype=bool)
    order = _in_order(names, seconds)
    start = np.flatnonzero(_changes(names[order], seconds[order]))
    least = np.minimum.reduceat(ids[order], start)
    out = np.zeros(len(names), dtype=bool)
    out[order] = ids[order] > np.repeat(least, np.diff(np.append(start, len(names))))
    return out


def _met_again(names: np.ndarray) -> np.ndarray:
    """Whether each name stands more than once."""
    order = np.argsort(names)
    same = names[order][1:] == names[order][:-1]
    out = np.zeros(len(names), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _columns(t: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [_values(x, kind) for x in t[column].to_pylist()]


def _pairs(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Both names of each window, sorted."""
    names, seconds = (np.concatenate([np.zeros(0, kind), *_columns(replies, c, kind)]) for c, kind in (("names", np.uint64), ("seconds", np.uint32)))
    order = _in_order(names, seconds)
    return names[order], seconds[order]


def _pairs_in(x: np.ndarray, y: np.ndarray, names: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Whether each pair is among the sorted pairs of names."""
    out = np.zeros(len(x), dtype=bool)
    at, left = np.searchsorted(names, x), np.arange(len(x))
    while len(left):
        left = left[at[left] < len(names)]
        left = left[names[at[left]] == x[left]]
        out[left] = seconds[at[left]] == y[left]
        left = left[~out[left]]
        at[left] += 1
    return out


def _names(replies: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *_columns(replies, "names", np.uint64)]))


def _isin_sorted(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), dtype=bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _reply(blocks: np.ndarray, **lists: list[np.ndarray]) -> pa.Table:
    """A row for each block that anything is said to."""
    some = [k for k, x in enumerate(lists["names"]) if len(x)]
    columns = {c: pa.array([_planes(values[k]) for k in some], type=pa.binary()) for c, values in lists.items()}
    return pa.table({"block": pa.array(blocks[some], type=pa.int32()), **columns})


_to_spaces = bytes.maketrans(bytes(np.flatnonzero(_blank).tolist()), b" " * int(_blank.sum()))


def _joined(t: pa.Table, removed: list[np.ndarray]) -> Iterator[tuple[int, int, str]]:
    """(words, removed words, kept words joined by a space) of each document."""
    for text, gone in zip(t["text"].to_pylist(), removed, strict=True):
        data = (text or "").encode("utf-8", "replace").translate(_to_spaces)
        cut = int(np.count_nonzero(gone))
        if cut:
            data = b" ".join(compress(data.split(), (~gone).tolist()))
        elif b"  " in data or data[:1] == b" " or data[-1:] == b" ":
            data = b" ".join(data.split())
        yield len(gone), cut, data.decode()


def _windows(docs: DataFrame) -> tuple[Blocks, DataFrame]:
    blocks = Blocks(docs)
    return blocks, blocks.repeated_windows(blocks.shared_anchors())


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string) for each row of ``docs`` (doc_id, text; other columns are not read).

    A word goes if a window of 13 words that covers it also starts in a document of a smaller doc_id. Null and blank texts
    have no words. A null doc_id counts as larger than all others, and rows that share an id as one document. doc_id is of an
    integer type, as "smaller" is by number.
    """

    def finish(t, removed):
        rows = [*_joined(t, removed)]
        columns = [t["doc_id"], *(pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    blocks, windows = _windows(docs.select("doc_id", "text"))
    return blocks.apply(windows, finish, f"doc_id {_kind(docs)}, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """removals() with the SHA-256 of the kept text in place of it, so that texts do not leave the worker."""

    def finish(t, removed):
        rows = [(n, m, hashlib.sha256(kept.encode()).hexdigest()) for n, m, kept in _joined(t, removed)]
        columns = [t["doc_id"], *(pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    blocks, windows = _windows(docs.select("doc_id", "text"))
    return blocks.apply(windows, finish, f"doc_id {_kind(docs)}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (documents' columns) without what removals() takes: a text that loses words is its kept words joined by a
    space, and n_chars their length. All rows stay, texts that lose nothing as they were."""

    def finish(t, removed):
        texts = [text if not cut else kept for text, (_, cut, kept) in zip(t["text"].to_pylist(), _joined(t, removed), strict=True)]
        t = t.set_column(t.schema.get_field_index("text"), "text", pa.array(texts, type=pa.string()))
        return t.drop_columns([block])

    schema = docs.schema
    blocks, windows = _windows(docs)
    block = blocks.block
    out = blocks.apply(windows, finish, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
