"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import TABLE_ROWS, ChunkTable
from .common import document_batches, given_back

#: The marker that stands for a space.
MARK = "▁"
_spaced = re.compile(r" +[^ ]*")


def marked_words(text: str) -> list[str]:
    """The chunks of a text, each without the one marker that the encoder puts before it.

    A chunk starts at a marker whose predecessor is none, and holds a run of markers and the characters up to the next
    run. Their pieces, with a marker before the whole text as the encoder sets it, are the pieces of the text.
    """
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _spaced.findall(f" {text}")]
    return text.split(" ")


class Pieces:
    """A processor made from a model's bytes, with what the distinct-word table needs to hold of it."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        crossing = any(MARK in x.lstrip(MARK) for x in pieces)
        plain = self.sp.encode(["a  ﬁ b", "Ⅲ"], out_type=str) and self.sp.decode(self.sp.encode(" a  ﬁ \n")) == " a  ﬁ \n"
        #: Where pieces cross markers, or the model rewrites its input, a whole text is one chunk.
        cut = marked_words if plain and not crossing else lambda text: [text]
        self.table = ChunkTable(cut, lambda chunks: [array("i", x).tobytes() for x in self._encoded(chunks)])
        self.written, self.odd = ChunkTable(cut, self._written), {}

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        """A chunk of no characters is a marker at the end of a text; the encoder puts none before an empty text."""
        lone = [self.sp.piece_to_id(MARK)]
        return [x if c else lone for c, x in zip(chunks, self.sp.encode(chunks, num_threads=1), strict=True)]

    def _written(self, chunks: list[str]) -> list[str]:
        """The ids of each chunk as decimals joined by commas.

        Each chunk is decoded too, and what does not come back as it was is kept in ``odd``. Decoding leaves out the first
        marker of what it is given, so the decoded text is that of its chunks joined by spaces.
        """
        ids = self._encoded(chunks)
        self.odd.update((c, t) for c, t in zip(chunks, self.sp.decode(ids, num_threads=1), strict=True) if c != t)
        return [str(x)[1:-1].replace(" ", "") for x in ids]

    def encode(self, batches: Iterable[pa.RecordBatch], text: str = "text", out: str = "ids") -> Iterator[pa.RecordBatch]:
        """``text`` becomes ``out``: list<int>."""
        for batch in batches:
            names = batch.schema.names
            for part, found in self.table.stream(batch.column(text).to_pylist()):
                rows = batch.slice(part.start, part.stop - part.start)
                lists = pa.array([np.frombuffer(b"".join(entries), dtype="<i4") for entries in found], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([lists if n == text else rows.column(n) for n in names], [out if n == text else n for n in names])

    def digests(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each (doc_id, text): the number of ids, and SHA-256 of the ids and of the decoded text."""
        for batch in batches:
            if len(self.odd) > TABLE_ROWS:
                self.odd.clear()
                self.written.clear()
            texts = batch.column("text").to_pylist()
            for part, found in self.written.stream(texts):
                columns = [[], [], []]
                for text, entries in zip(texts[part], found, strict=True):
                    chunks, decimals = self.written.cut(text) if text else [], ",".join(entries)
                    decoded = " ".join(chunks if self.odd.keys().isdisjoint(chunks) else [self.odd.get(c, c) for c in chunks])
                    for column, v in zip(columns, (decimals.count(",") + 1 if decimals else 0, _sha(decimals), _sha(decoded)), strict=True):
                        column.append(v)
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def decode(self, batches: Iterable[pa.RecordBatch], ids: str = "ids", out: str = "decoded") -> Iterator[pa.RecordBatch]:
        """``ids`` becomes ``out``: string. A null list gives the empty text."""
        for batch in batches:
            decoded = pa.array(self.sp.decode([x or [] for x in batch.column(ids).to_pylist()], num_threads=1) if batch.num_rows else [], type=pa.string())
            names = [n for n in batch.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), decoded], [*names, out])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@lru_cache(1)
def _pieces(model: bytes) -> Pieces:
    """One for each worker process, which outlives its tasks: so is the table of words."""
    return Pieces(model)


def _mapped(df: DataFrame, model_path: str, step: Callable[[Pieces, Iterable], Iterator], schema: str) -> DataFrame:
    """The model's bytes go with the job, so that executors need no file of that path."""
    model = df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches):
        yield from given_back(step(_pieces(model.value), batches))

    return document_batches(df).mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs`` (doc_id, text; other columns are not read).

    Ids are exactly those of the library's encode(text): no begin or end ids, no sampling. Null and empty texts have no
    ids. Rows are independent: repeated and null doc_ids are kept as they are, and nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _mapped(docs.select("doc_id", "text"), model_path, lambda p, it: p.encode(it), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, decoded string) for each row of ``encoded`` (doc_id, ids), by the library's decode(ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return _mapped(encoded.select("doc_id", "ids"), model_path, lambda p, it: p.decode(it), f"doc_id {kind}, decoded string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """encode() and decode() in one pass, of which each row keeps doc_id, the number of ids and SHA-256 of both results.

    Both are joined from the table: a word's ids and their decoded text are made once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _mapped(docs.select("doc_id", "text"), model_path, lambda p, it: p.digests(it), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
