"""A table of the distinct chunks of many texts: each is tokenized once, and what is known of it is joined back by position."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

#: Entries after which the table begins anew, and the longest chunk (in characters) that it keeps.
TABLE_ROWS, LONGEST = 400_000, 200
#: Characters of text that are tokenized at a time.
AT_ONCE = 1_000_000


class _Places(dict):
    """The place of each chunk among the entries; one that is met for the first time gets the next."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = place = len(self)
        self.new.append(chunk)
        return place


class ChunkTable:
    """``cut(text)`` gives the chunks of a text, ``describe(list of chunks)`` an entry for each, such as its ids."""

    def __init__(self, cut: Callable[[str], list[str]], describe: Callable[[list[str]], Iterable]):
        self.cut, self.describe = cut, describe
        self.clear()

    def clear(self) -> None:
        self.places, self.entries = _Places(), []

    def look_up(self, texts: list[str | None]) -> list[list]:
        """The entries of each text's chunks, in order; a null or empty text has none."""
        places = self.places
        at = [[*map(places.__getitem__, self.cut(x))] if x else [] for x in texts]
        new, places.new = places.new, []
        self.entries.extend(self.describe(new) if new else ())
        out = [[*map(self.entries.__getitem__, x)] for x in at]
        if len(places) > TABLE_ROWS or max(map(len, new), default=0) > LONGEST:
            self._drop(new)
        return out

    def _drop(self, new: list[str]) -> None:
        """A long chunk keeps its place, without its name and its entry, so that the others keep theirs."""
        if len(self.entries) > TABLE_ROWS:
            self.clear()
            return
        for c in new:
            if len(c) > LONGEST:
                place = self.places.pop(c)
                self.places[place] = place
                self.entries[place] = None

    def stream(self, texts: list[str | None]) -> Iterator[tuple[slice, list[list]]]:
        """The entries of many texts, some at a time: (their slice, their entries)."""
        begin, held = 0, 0
        for k, x in enumerate(texts):
            held += len(x or "")
            if held >= AT_ONCE or k == len(texts) - 1:
                part = slice(begin, k + 1)
                yield part, self.look_up(texts[part])
                begin, held = k + 1, 0
