"""Packing of tokenized documents into windows of several lengths."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkTable
from .common import document_batches, given_back

#: Lengths of the windows, one tier each; every one is a power of two.
TIERS = (256, 512, 1024, 2048)
#: The id after each document, and the bytes of an id.
END, WIDTH = 1, 4
_end = array("I", [END]).tobytes()
#: Tokens that are packed together. What a block leaves over is the only padding: less than one longest window a block.
BLOCK = 2_000_000
#: Tokens of a step group, a multiple of every tier: so groups of any tier hold as many tokens.
STEP = 65_536

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"
_after_space, _cut = re.compile(r"\s(?= )"), re.compile(r"(?<!\s) ")


def spaced_chunks(text: str) -> list[str]:
    """Chunks of a text for a byte-level tokenizer: each starts at a space whose predecessor is no white space.

    No pre-token spans such a place, so each chunk's ids are those it has in the text. The first chunk, which need not
    start with a space, is marked by a NUL; the others are given without their first space.
    """
    if "\0" in text:
        return ["\0" + text]
    parts = _cut.split(text) if len(_after_space.split(text, 1)) > 1 else text.split(" ")
    parts[0] = "\0" + parts[0]
    return parts


#: What a byte-level vocabulary of this kind cuts texts at before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Both encoders cut printable chunks alike that hold white space at most as their first character, and are ASCII or of these
#: letters alone: none of later scripts. Single line breaks may stand between other characters.
_latin, _broken = (re.compile(x).fullmatch for x in ("[\x20-\x7e\xa1-\u024f]*", r" ?[^\s]+(\n[^\s]+)+"))


def _is_plain(x: str) -> bool:
    if "\n" in x:
        x = x.replace("\n", "") if _broken(x) is not None else "\n"
    return x != "" and x.isprintable() and x.find(" ", 1) < 0 and (x.isascii() or _latin(x) is not None)


_probe = (" the", "\0Don't stop", " l'été", " 12,5%%%", "\0\n\nA_b", " straße\n", " x  y", " ñandú!!", "\0<tag>|", " Zürich'll", " end.\nStart", " a\n\xa1b\n1")


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Ids of a ``tokenizers`` file, as its library gives them without adding special tokens.

    A text that holds the string of a special token is one chunk, which always goes to the library that the file is of, so
    that it finds the token there. Other chunks of plain Latin text go to a second encoder of the same vocabulary, which
    takes a quarter of the time; whether the two agree is tried beforehand by ``agrees``. All others go to the library.
    """

    def __init__(self, vocabulary: str, quick: bool = False):
        self.vocabulary, self._full = vocabulary, None
        self.special = [x["content"] for x in json.loads(vocabulary)["added_tokens"]]
        self.quick = self._quick() if quick else None
        self.table = ChunkTable(self._chunks, self._encode)

    def _holds_special(self, text: str) -> bool:
        return any(x in text for x in self.special)

    def _chunks(self, text: str) -> list[str]:
        return ["\0" + text] if self._holds_special(text) else spaced_chunks(text)

    @property
    def full(self):
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_str(self.vocabulary)
        return self._full

    def _quick(self):
        import tiktoken

        letters = _byte_letters()
        vocabulary = json.loads(self.vocabulary)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        return tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def agrees(self) -> bool:
        """Whether both encoders give the same ids for the probes and for each token of the vocabulary that is plain text."""
        try:
            quick = self._quick()
        except (ImportError, KeyError, ValueError):
            return False
        letters = _byte_letters()
        written = (bytes(letters[c] for c in t).decode(errors="replace") for t in json.loads(self.vocabulary)["model"]["vocab"] if t not in self.special)
        texts = [*map(_text, _probe), *(x for x in written if _is_plain(x))]
        return [*map(quick, texts)] == self._slow(texts)

    def _slow(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in range(0, len(texts), 2000):
            out.extend(x.ids for x in self.full.encode_batch_fast(texts[k : k + 2000], add_special_tokens=False))
        return out

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as uint32."""
        texts = [" " + c if c[:1] != "\0" else c[1:] for c in chunks]
        # The first test is that of most chunks, without a call.
        plain = [x.isascii() and x.isprintable() and x.find(" ", 1) < 0 and x != "" or _is_plain(x) for x in texts] if self.quick else [False] * len(texts)
        plain = [p and not (c[:1] == "\0" and self._holds_special(c)) for p, c in zip(plain, chunks, strict=True)]
        quick = iter(self._quickly([*compress(texts, plain)]))
        rest = iter(self._slow([x for x, p in zip(texts, plain, strict=True) if not p]))
        return [next(quick) if p else array("I", next(rest)).tobytes() for p in plain]

    def _quickly(self, texts: list[str]) -> list[bytes]:
        """Many chunks as one text, with a line break after each; a line break is a token by itself wherever it stands there."""
        if not texts:
            return []
        ids = np.array(self.quick("\n".join([*texts, ""])), dtype="<u4")
        breaks = np.flatnonzero(ids == self.quick("\n")[0])
        ends = breaks[np.cumsum([x.count("\n") + 1 for x in texts]) - 1] * WIDTH
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *(ends[:-1] + WIDTH).tolist()], ends.tolist(), strict=True)]

    def ids(self, texts: list[str | None]) -> Iterator[tuple[slice, list[bytes]]]:
        """The ids of many texts, some at a time: (their slice, the ids of each as uint32)."""
        for part, found in self.table.stream(texts):
            yield part, [*map(b"".join, found)]


@lru_cache(1)
def _tokens(vocabulary: str, quick: bool) -> ByteTokens:
    """One for each worker process, which outlives its tasks: so is the table of chunks."""
    return ByteTokens(vocabulary, quick)


def _text(chunk: str) -> str:
    return chunk[1:] if chunk[:1] == "\0" else " " + chunk


class Block:
    """Documents that are packed together: first whole windows, then each tier from the longest to the shortest.

    The rest of a document goes to the shortest tier that holds it. A window of a tier starts with a piece of that tier;
    its gap is filled from the shorter tiers, with the longest piece that fits, or else with the start of one that
    doesn't. When nothing is left to fill it with, the window is cut into shorter ones.
    """

    def __init__(self):
        self.docs: list[tuple[object, memoryview]] = []
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> None:
        """``ids`` are those of a document as uint32."""
        self.docs.append((doc_id, memoryview(ids)))
        self.tokens += len(ids) // WIDTH

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document's place, start, length)."""
        top = TIERS[-1]
        stacks: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]
        self.present = 0

        def put(doc: int, start: int, n: int) -> None:
            stacks[n].append((doc, start))
            self.present |= 1 << n

        def take(n: int) -> tuple[int, int]:
            found = stacks[n].pop()
            if not stacks[n]:
                self.present &= ~(1 << n)
            return found

        for k, (_, ids) in enumerate(self.docs):
            n = len(ids) // WIDTH
            whole = n // top * top
            for start in range(0, whole, top):
                yield [(k, start, top)]
            if n > whole:
                put(k, whole, n - whole)
        for window, below in zip(TIERS[::-1], [*TIERS[-2::-1], 0], strict=True):
            while n := self.present.bit_length() - 1 if self.present.bit_length() - 1 > below else 0:
                sequence, gap = [(*take(n), n)], window - n
                while gap and self.present:
                    fits = (self.present & ((1 << (gap + 1)) - 1)).bit_length() - 1
                    if fits > 0:
                        sequence.append((*take(fits), fits))
                        gap -= fits
                    else:
                        least = (self.present & -self.present).bit_length() - 1
                        doc, start = take(least)
                        sequence.append((doc, start, gap))
                        put(doc, start + gap, least - gap)
                        gap = 0
                yield from [sequence] if not gap else split(sequence, window - gap)


def split(sequence: list[tuple[int, int, int]], n: int) -> Iterator[list[tuple[int, int, int]]]:
    """A sequence of n tokens as sequences of a tier's length each, and what is shorter than any tier as the last."""
    for size in [t for t in TIERS[::-1] if n & t] + [n % TIERS[0]] * bool(n % TIERS[0]):
        part, room = [], size
        while room:
            doc, start, length = sequence.pop(0)
            part.append((doc, start, min(length, room)))
            if length > room:
                sequence.insert(0, (doc, start + room, length - room))
            room -= part[-1][2]
        yield part


def _pack(tokens: ByteTokens, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    sequence_id, groups, filled = base, 0, {}
    block, schema = Block(), None

    def rows():
        nonlocal sequence_id, groups
        out = {n: [] for n in ("doc", "start", "length", "crc", "tokens", "sequence", "offset", "window", "group")}
        for sequence in block.sequences():
            total = sum(n for _, _, n in sequence)
            window = total if total & (total - 1) == 0 else TIERS[-1]
            group, room = filled.get(window, (0, 0))
            if room < window:
                group, room, groups = base + groups, STEP, groups + 1
            filled[window] = (group, room - window)
            offset = 0
            for doc, start, n in sequence:
                doc_id, ids = block.docs[doc]
                for k, v in zip(out, (doc_id, start, n, zlib.crc32(ids[WIDTH * start : WIDTH * (start + n)]), len(ids) // WIDTH, sequence_id, offset, window, group), strict=True):
                    out[k].append(v)
                offset += n
            sequence_id += 1
        columns = [pa.array(out["doc"], type=schema.field("doc_id").type), *(pa.array(v, type=pa.int64()) for k, v in out.items() if k != "doc")]
        names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        schema = batch.schema
        doc_ids = batch.column("doc_id").to_pylist()
        for part, lists in tokens.ids(batch.column("text").to_pylist()):
            for doc_id, ids in zip(doc_ids[part], lists, strict=True):
                block.add(doc_id, ids + _end)
                if block.tokens >= BLOCK:
                    yield rows()
                    block = Block()
    if block.docs:
        yield rows()


def pack(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text; other columns are not read) in sequences of at most 2048 tokens.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (the length that its sequence is
    padded to) and step_group (sequences of one window length that hold 65,536 tokens together, the last ones of a
    partition fewer). Null and empty texts are a document of the end id alone; rows are independent of each other, so
    repeated and null doc_ids are documents of their own. Nothing is shuffled: each partition packs its own documents,
    about two million tokens at a time, and numbers its sequences from its own range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = Path(vocabulary_path).read_text()
    quick = ByteTokens(text).agrees()
    vocabulary = docs.sparkSession.sparkContext.broadcast(text)

    def run(batches):
        yield from given_back(_pack(_tokens(vocabulary.value, quick), batches))

    return document_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
