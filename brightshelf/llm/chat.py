"""Chat formatting by a finite-state machine over roles."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back


@dataclass(frozen=True)
class Template:
    """What is written around each turn, which turns are learnt, and which turn may follow which.

    Every control string begins with ``opening``, and a turn's mark ends with ``closing``. Inside texts and roles ``escape``
    is put before each ``escape`` and within each of those two, so none can hold a part of a control string, and reading
    back is exact.
    """

    opening: str = "<|"
    closing: str = "|>"
    escape: str = "\\"
    turn: str = "<|turn {role} |>\n"
    end: str = "<|end|>\n"
    learnt: frozenset = frozenset({"assistant"})
    start: str = "start"
    follows: dict = field(default_factory=lambda: {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        for mark in (self.opening, self.closing):
            text = text.replace(mark, mark[0] + self.escape + mark[1:])
        return text

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def read(self, text: str) -> tuple[list[tuple[str, str]], str]:
        """The (role, text) of each whole turn at the start of a formatted text, and what follows them."""
        before, after = self.turn.split("{role}")
        turns, at = [], 0
        while (end := text.find(self.end, at)) >= 0:
            mark = text.find(after, at)
            if not text.startswith(before, at) or not 0 <= mark < end:
                raise ValueError("no turn's mark where a turn begins")
            turns.append((self.unescaped(text[at + len(before) : mark]), self.unescaped(text[mark + len(after) : end])))
            at = end + len(self.end)
        return turns, text[at:]


DEFAULT = Template()
SEGMENTS = "seq long, turn_no long, text string, loss boolean, ok boolean"
_names = ["conv_id", *(x.split()[0] for x in SEGMENTS.split(", "))]
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Segments of a batch.
AT_ONCE = 3000


def _format(template: Template, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (conv_id, turn): three segments a turn. Only the state of one conversation is held."""
    now, state, seq, turn_no, ok, kind = object(), "", 0, 0, True, None
    rows: list[tuple] = []
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now:
                now, state, seq, turn_no, ok = conv, template.start, 0, 0, True
            role, text = role or "", text or ""
            ok = ok and role in template.follows.get(state, ())
            state = role
            loss = role in template.learnt
            for body, learnt in ((template.turn.format(role=template.escaped(role)), False), (template.escaped(text), loss), (template.end, False)):
                rows.append((conv, seq, turn_no, body, learnt, ok))
                seq += 1
            turn_no += 1
            if len(rows) >= AT_ONCE:
                yield _batch(rows, kind)
                rows = []
    if rows:
        yield _batch(rows, kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _names)


def _read(template: Template, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by (conv_id, seq): what a reader of the formatted text finds, a row per conversation.

    Turns are found by their control strings alone, wherever segments begin and end.
    """
    kinds: list[pa.DataType] = []

    def segments():
        for batch in batches:
            kinds[:] = [batch.schema.field("conv_id").type]
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True)

    out: list[tuple] = []
    for conv, of_conv in groupby(segments(), key=lambda x: x[0]):
        turns, learnt, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        held, tail = [], ""
        for _, text, loss in of_conv:
            chars += len(text)
            if loss:
                under = template.unescaped(text)
                learnt.update(under.encode())
                loss_chars += len(under)
            held.append(text)
            tail = tail[1 - len(template.end) :] + text
            if template.end in tail:
                found, rest = template.read("".join(held))
                for role, said in found:
                    turns.update(f"{role}\n{said}\n".encode())
                n += len(found)
                held, tail = [rest], rest
        if "".join(held):
            raise ValueError("a turn without its end")
        out.append((conv, n, turns.hexdigest(), loss_chars, learnt.hexdigest(), chars))
        if len(out) >= AT_ONCE:
            yield _digests(out, kinds[0])
            out = []
    if out:
        yield _digests(out, kinds[0])


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", *(x.split()[0] for x in DIGESTS.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _in_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _conv(df: DataFrame) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}"


def segments(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The formatted text of ``conversations`` (conv_id, turn, role, text; other columns are not read) in segments.

    Three rows a turn, in the order of seq: the turn's mark, its text, its end. ``loss`` is true on the texts of learnt
    roles alone. ``ok`` is false from the first turn on that may not follow the one before it. Turns are ordered by turn;
    ties by role and text, nulls first. Null roles and texts are empty; rows without a conv_id are one conversation.
    Rows are streamed in their order, so the length of a conversation does not matter.
    """
    return _in_order(conversations).mapInArrow(lambda it: given_back(_format(template, it)), f"{_conv(conversations)}, {SEGMENTS}")


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation of ``formatted`` (as segments() returns it): what can be read from its text and loss flags."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(lambda it: given_back(_read(template, it)), f"{_conv(formatted)}, {DIGESTS}")


def formatted_and_read(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """read_back(segments(...)) without a second shuffle: a partition's segments are read as they are written."""
    return _in_order(conversations).mapInArrow(lambda it: given_back(_read(template, _format(template, it))), f"{_conv(conversations)}, {DIGESTS}")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one (-7) whose texts look like control strings of a chat."""
    kinds = conversations.select("conv_id", "turn").schema
    said = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast(kinds["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(kinds["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").union(probe)
