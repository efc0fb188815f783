"""Token counts by a finite-state transducer, compiled from a tokenizer's vocabulary while texts are read."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import document_batches, given_back

#: Signs of a chunk, and of the texts that are read at a time.
CHUNK, AT_ONCE = 512, 1_000_000
#: States after which the transducer is compiled anew, so that its tables stay bounded.
STATES = 400_000
#: Pairs of tokens that are remembered.
PAIRS = 500_000
#: Walks below which the rest of a step is done one by one.
FEW = 16
#: A transition is one number: the next state above SHIFT bits of the emitted count, of which OFFSET stands for none.
SHIFT, OFFSET = 8, 128
#: Signs: a byte within a word, 256 more for the byte that ends one, a special token, and what changes nothing.
SPECIAL, SKIP, SIGNS = 512, 513, 514
#: Places in the hash table of transitions: the high ones of 62 bits of a product.
MULTIPLIER, MASK = 0x1E3779B97F4A7C15, (1 << 62) - 1

#: Classes of code points: what ends a word, letters, numbers, and all others.
SPACE, LETTER, NUMBER, OTHER = range(4)

#: What this compiler is for; another tokenizer's file is refused.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Endings after an apostrophe, which are words with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """The vocabulary's tokens as strings of signs: 0 - 255 a byte within a word, 256 - 511 the byte that ends one.

    The tokens of a string of signs are found from left to right. Of the tokens that end a prefix one alone can be the
    last of its tokens: that which is a pair with the last token before it, that is, whose two strings joined have these
    two as their tokens. That holds of merges whose results are distinct, which is verified.
    """

    def __init__(self, model: dict):
        letters = byte_letters()
        end = model["end_of_word_suffix"]
        self.ids: dict[tuple[int, ...], int] = {}
        self.text: list[tuple[int, ...]] = []
        of_letter = {c: b for b, c in enumerate(letters)}
        signs = {}
        for b, c in enumerate(letters):
            signs[c], signs[c + end] = (b,), (256 + b,)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for c, s in signs.items():
            if c not in model["vocab"] or of_letter.get(c[0]) != s[0] % 256:
                raise ValueError("a byte is missing from the vocabulary")
            self._add(s)
        for k, (a, b) in enumerate(model["merges"]):
            if a + b in signs or a not in signs or b not in signs:
                raise ValueError("merges must have distinct results, made of what came before")
            signs[a + b] = signs[a] + signs[b]
            self.rank[self.ids[signs[a]], self.ids[signs[b]]] = (k, self._add(signs[a + b]))
        self._automaton()
        self._pairs: dict[int, bool] = {}

    def _add(self, s: tuple[int, ...]) -> int:
        self.ids[s] = len(self.text)
        self.text.append(s)
        return len(self.text) - 1

    def _automaton(self) -> None:
        """A trie of the tokens with, for each node, its longest proper suffix that is a node too."""
        self.next: dict[int, int] = {}
        self.token, self.depth, parent = [-1], [0], [0]
        for t, s in enumerate(self.text):
            node = 0
            for x in s:
                found = self.next.get(node << 9 | x)
                if found is None:
                    found = self.next[node << 9 | x] = len(parent)
                    parent.append(node)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = found
            self.token[node] = t
        #: Whether longer tokens begin with a node's string; only such nodes are kept in a state.
        self.longer = [False] * len(parent)
        for node in parent:
            self.longer[node] = True
        self.up = [0] * len(parent)
        for key, child in sorted(self.next.items(), key=lambda x: self.depth[x[1]]):
            node, sign = key >> 9, key & 511
            up = self.up[node]
            while up and up << 9 | sign not in self.next:
                up = self.up[up]
            self.up[child] = self.next.get(up << 9 | sign, 0) if node else 0
        for node in sorted(range(len(parent)), key=self.depth.__getitem__):
            up = self.up[node]
            self.up[node] = up if self.longer[up] else self.up[up]

    def tokens(self, s: tuple[int, ...]) -> list[int]:
        """The tokens of a string of signs, by its merges one after the other: that of the lowest rank first, then the leftmost."""
        parts = [self.ids[x,] for x in s]
        while len(parts) > 1:
            best = min(((self.rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            (_, t), k = best
            parts[k : k + 2] = [t]
        return parts

    def pair(self, a: int, b: int) -> bool:
        """Whether two tokens may follow each other; with -1, whether a word may begin with the second."""
        key = a << 32 | b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self.tokens((self.text[a] if a >= 0 else ()) + self.text[b]) == [a, b][a < 0 :]
        return found

    #: The state of an empty prefix. A state is a node, and for each suffix of the prefix that longer tokens begin with, the
    #: longest first, the last token before that suffix and how many more tokens the prefix has than what is before the suffix, as
    #: one number, the latter plus 64; the last token is -1 where the prefix begins. No other suffix can become the start of a token.
    START = (0, -1 << 8 | 64)

    def read(self, state: tuple[int, ...], sign: int) -> tuple[tuple[int, ...], int]:
        """The state after one more sign, and how many more tokens the prefix then has."""
        node, next_, up, token, depth = state[0], self.next, self.up, self.token, self.depth
        nodes = []
        before = {}
        k = 1
        while True:
            before[depth[node]] = state[k]
            child = next_.get(node << 9 | sign)
            if child is not None:
                nodes.append(child)
            if not node:
                break
            node, k = up[node], k + 1
        for child in nodes:
            t = token[child]
            if t >= 0:
                known = before[depth[child] - 1]
                if self.pair(known >> 8, t):
                    emitted = 65 - (known & 255)
                    kept = [x for x in nodes if self.longer[x]]
                    after = (before[depth[x] - 1] + emitted for x in kept)
                    return (kept[0] if kept else 0, *after, t << 8 | 64), emitted
        raise ValueError("no token ends this prefix")


class Transducer:
    """A table of (state, sign) -> (state, emitted tokens) over the signs of many words.

    Transitions are made when they are first met and kept in a hash table of two arrays, which many look up together. A sign
    that ends a word leads to the first state.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self._begin()

    def _begin(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {Merges.START: 0}
        self.states: list[tuple[int, ...]] = [Merges.START]
        self.bits, self.made = 14, 0
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)

    def _renewed(self, numbers: np.ndarray) -> np.ndarray:
        """A table that is full begins anew, with the states that are in use."""
        used, at = np.unique(numbers, return_inverse=True)
        states = [self.states[k] for k in used.tolist()]
        self._begin()
        return np.array([self._number(x) for x in states], dtype=np.int64)[at]

    def _number(self, state: tuple[int, ...]) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def _at(self, key):
        return (key * MULTIPLIER & MASK) >> 62 - self.bits

    def _grow(self) -> None:
        kept = self.keys >= 0
        keys, values = self.keys[kept], self.values[kept]
        self.bits += 1
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        for key, value in zip(keys.tolist(), values.tolist(), strict=True):
            self._put(key, value)

    def _put(self, key: int, value: int) -> None:
        at, keys, last = self._at(key), self.keys, len(self.keys) - 1
        while keys[at] >= 0:
            at = at + 1 & last
        keys[at], self.values[at] = key, value

    def _make(self, key: int) -> int:
        """The transition of a state on a sign, put into the table."""
        number, sign = divmod(key, SIGNS)
        if sign == SKIP:
            value = number << SHIFT | OFFSET
        elif sign == SPECIAL:
            value = OFFSET + 1
        else:
            state, emitted = self.merges.read(self.states[number], sign)
            value = (0 if sign >= 256 else self._number(state)) << SHIFT | emitted + OFFSET
        if 3 * self.made > len(self.keys):
            self._grow()
        self.made += 1
        self._put(key, value)
        return value

    def _step(self, state: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of many states, the next ones and what is emitted."""
        key = state * SIGNS + signs
        at = self._at(key)
        value = self.values.take(at)
        there = self.keys.take(at)
        open_ = np.flatnonzero(there != key)
        while len(open_):
            empty = there[open_] < 0
            if empty.any():
                # All keys that are missing are made, and looked up again.
                new, back = np.unique(key[open_[empty]], return_inverse=True)
                value[open_[empty]] = np.array([self._make(k) for k in new.tolist()], dtype=np.int32)[back]
                open_ = open_[~empty]
                at = self._at(key)
                there[open_] = self.keys.take(at[open_])
                hit = there[open_] == key[open_]
            else:
                at[open_] = at[open_] + 1 & len(self.keys) - 1
                there[open_] = self.keys.take(at[open_])
                hit = there[open_] == key[open_]
            value[open_[hit]] = self.values.take(at[open_[hit]])
            open_ = open_[~hit]
        return (value >> SHIFT).astype(np.int64), (value & (1 << SHIFT) - 1) - OFFSET

    def emitted(self, signs: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The count that each sign's transition emits, from the first state on.

        ``begins`` marks signs before which any word has ended, so that each state is there the first one. Chunks are read at
        the same time. A chunk's map of states is a walk up to its first such place and constant from there on, so its last
        part is read first. The maps are then composed by a prefix scan, a running maximum of the last chunk with such a
        place, which gives each open beginning its state; these are read at the end.
        """
        n = len(signs)
        lanes = -(-n // CHUNK)
        grid, marked = np.full(lanes * CHUNK, SKIP, dtype=np.int64), np.zeros(lanes * CHUNK, dtype=bool)
        grid[:n], marked[:n], marked[0] = signs, begins, True
        marked, grid = marked.reshape(lanes, CHUNK), grid.reshape(lanes, CHUNK)
        first = np.where(marked.any(1), marked.argmax(1), CHUNK)
        grid[np.arange(CHUNK) < first[:, None]] = SKIP
        state, counts = np.zeros(lanes, dtype=np.int64), np.zeros((CHUNK, lanes), dtype=np.int8)
        for k, column in enumerate(np.ascontiguousarray(grid.T)):
            if len(self.states) > STATES:
                state = self._renewed(state)
            state, counts[k] = self._step(state, column)
        out = np.ascontiguousarray(counts.T).reshape(-1)[:n]
        # The scan: an open beginning gets the state of the last chunk before it that has a place. Open signs that follow each
        # other, of one chunk or several, are one walk, from the end of that chunk to the first place after it.
        last = np.maximum.accumulate(np.where(first < CHUNK, np.arange(lanes), -1))
        places = np.flatnonzero(last == np.arange(lanes))
        at, until, state = np.minimum((places + 1) * CHUNK, n), np.append(places[1:] * CHUNK + first[places[1:]], n), state[places]
        while len(at):
            if len(self.states) > STATES:
                state = self._renewed(state)
            left = at < until
            state, at, until = state[left], at[left], until[left]
            if len(at) <= FEW:
                for walk in zip(state.tolist(), at.tolist(), until.tolist(), strict=True):
                    self._walk(signs, out, *walk)
                break
            state, out[at] = self._step(state, signs[at])
            at = at + 1
        return out

    def _walk(self, signs: np.ndarray, out: np.ndarray, number: int, at: int, until: int) -> None:
        """One by one, by the states themselves."""
        state = self.states[number]
        for k, sign in enumerate(signs[at:until].tolist(), at):
            state, out[k] = self.merges.read(state, sign)


class Counter:
    """Counts the tokens of texts as the library does with a file of this kind."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        split, model = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{"type": ""}], spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers") or ()], [x["type"] for x in split]
        odd = model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or spec.get("post_processor") or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or split[0]["pattern"] != {"Regex": WORDS} or odd:
            raise ValueError("this tokenizer's file is of another kind")
        # Neither truncation nor padding is part of a count.
        library = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.normalized, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        contents = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.transducer = Transducer(Merges(model))
        self.simple, self.classes = _Simple(self.normalized), np.full(0x110000, 255, dtype=np.uint8)
        self._classify(np.arange(128))

    def _classify(self, points: np.ndarray) -> None:
        """Classes of code points by what the library's own cutting makes of them."""
        for p in points.tolist():
            c = chr(p)
            words = len(self.cut(f"a{c}")), len(self.cut(f"!{c}"))
            if not self.cut(c):
                self.classes[p] = SPACE
            else:
                self.classes[p] = LETTER if words[0] == 1 else OTHER if words[1] == 1 else NUMBER

    def _written(self, text: str) -> str:
        """The text as the normalizer writes it, but for white space."""
        if text.isascii():
            return text.lower()
        return "".join(map(self._piece, re.split("(?= )", text))) if self.simple.hard(text) else text.translate(self.simple)

    def _piece(self, part: str) -> str:
        """Nothing is composed over a space, so what lies between two is normalized by itself."""
        return part.lower() if part.isascii() else self.normalized(part) if self.simple.hard(part) else part.translate(self.simple)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        parts, lengths, marks = [], [], []
        for text in texts:
            pieces = self.special.split(text) if text and self.special and "<" in text else [text or ""]
            # A special token becomes one character, whose place is noted.
            written = [self._written(x) for x in pieces]
            at = sum(lengths)
            size = len(written[0])
            for x in written[1:]:
                marks.append(at + size)
                size += 1 + len(x)
            parts.append("\0".join(written))
            lengths.append(size + 1)
        whole = " ".join([*parts, ""])
        signs, begins, starts = self._signs(whole, np.array(marks, dtype=np.int64), np.array(lengths, dtype=np.int64))
        return np.add.reduceat(self.transducer.emitted(signs, begins), starts, dtype=np.int64)

    def _signs(self, text: str, marks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The signs of a text, where words and what is between them begin, and the sign at which each of its parts starts.

        Words are what the pattern finds: runs of letters or of others, single numbers, and an apostrophe that begins a run with
        one of its endings, after which a new word begins. ``marks`` are the places of special tokens.
        """
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        single = len(raw) == len(text)
        points = raw if single else np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        if not single:
            seen = np.unique(points)
            self._classify(seen[self.classes[seen] == 255])
        kind = self.classes[points]
        kind[marks] = SPACE
        begins = np.ones(len(points), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == SPACE)
        apart = np.flatnonzero((points == 0x27) & begins)
        # The text ends with a space, so two more are there only to be looked at.
        after = np.append(points, [0x20, 0x20])
        for ending in ENDINGS:
            found = apart[np.all([after[apart + 1 + k] == ord(c) for k, c in enumerate(ending)], axis=0)]
            begins[found + 1] = False
            begins[found + 1 + len(ending)] = True
        first = np.cumsum(lengths) - lengths
        signs = raw.astype(np.int64)
        if single:
            lead, end = slice(None), np.append(begins[1:], True)
            starts, at = begins, marks
        else:
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            starts = np.zeros(len(raw), dtype=bool)
            starts[lead] = begins
            end, at, first = np.append(starts[1:], True), lead[marks], lead[first]
        signs[end] += 256
        if single:
            signs[kind == SPACE] = SKIP
        else:
            signs[np.repeat(kind == SPACE, np.diff(np.append(lead, len(raw))))] = SKIP
        signs[at] = SPECIAL
        return signs, starts, first

    def stream(self, texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray]]:
        begin, held = 0, 0
        for k, x in enumerate(texts):
            held += len(x or "")
            if held >= AT_ONCE or k == len(texts) - 1:
                yield slice(begin, k + 1), self.counts(texts[begin : k + 1])
                begin, held = k + 1, 0

    def counted(self, batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for part, n in self.stream(text.to_pylist()):
                of = text.slice(part.start, part.stop - part.start)
                size = pc.fill_null(pc.binary_length(of), 0).cast(pa.int64())
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, size, pa.array(n, type=pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


class _Simple(dict):
    """What the normalizer makes of single code points. Those that it may join or reorder with their neighbours are hard."""

    def __init__(self, normalized):
        self.normalized, self.not_hard = normalized, set(map(chr, range(128)))

    def __missing__(self, point: int):
        found = self[point] = self.normalized(chr(point))
        return found

    def hard(self, text: str) -> bool:
        new = set(text) - self.not_hard
        if not new:
            return False
        hard = {c for c in new if unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cn" or unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or "ᄀ" <= c <= "ᇿ"}
        self.not_hard |= new - hard
        return bool(hard)


@lru_cache(1)
def _counter(vocabulary: str) -> Counter:
    """One for each worker process, which outlives its tasks: so is its transducer."""
    return Counter(vocabulary)


def counted(docs: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text; other columns are not read).

    n_tokens is the number of ids that the library of the vocabulary's file gives for the whole text, without added special
    tokens; a special token's string inside a text is that token, as it is by the library's default. n_bytes is the length
    in UTF-8, over_limit whether n_tokens > ``limit``. Null and empty texts have no tokens. Rows are independent: repeated
    and null doc_ids are kept as they are, and nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text())

    def run(batches):
        yield from given_back(_counter(vocabulary.value).counted(batches, limit))

    return document_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
