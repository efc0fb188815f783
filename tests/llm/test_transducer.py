"""Token counts by the transducer against the library."""

import random
from collections import Counter as Multiset

import public_tokenizers
import pytest

from brightshelf.llm import queries as Q
from brightshelf.llm import transducer as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.fixture(scope="module")
def counter():
    with open(PATH) as f:
        return T.Counter(f.read())


SIGNS = [*"abcdefghijklmnopqrstuvwxyz'''' \n\t.,!?<>|0123456789éàüßñÉÀÜİΣςк日本語한각ᄀ", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'re", "'ll", "'ve", "don't", "́", "é", " ", " ", "🙂", "ﬁ", "\x85", "\x1c", "\0"]
SIGNS += ["the", "ing", "tion", "ạ́", "각", "½", "²", "٣", "​", "Ⅷ", "ǅ", "Å", "क़", "ẛ̣", "'R", "'", " '", "''s"]
LONG = ["", None, " ", "\n\n", "a" * 5000, "ab" * 4000, "'" * 700, "é" * 3000, "日" * 2000, "." * 1500 + "a" * 600 + "1" * 600, "<|endoftext|>" * 50, "x<|endoftext|>y", "<|ENDOFTEXT|>", "the " * 3000, "🙂" * 300, "'re'r e've'v'l'll'lll"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.choice([1, 2, 5, 20, 60, 700]))) for _ in range(n)]


def counts(counter, texts):
    return [n for _, part in counter.stream(texts) for n in part.tolist()]


def test_odd_texts(counter, library):
    texts = odd_texts(1500, 7) + LONG
    assert counts(counter, texts) == library(texts)
    assert counts(counter, []) == []


@pytest.mark.parametrize("chunk, few, states", [(1, 1, 400_000), (3, 1000, 400_000), (7, 2, 60)])
def test_chunks_of_any_length_and_tables_that_begin_anew(library, chunk, few, states, monkeypatch):
    for name, value in {"CHUNK": chunk, "FEW": few, "STATES": states}.items():
        monkeypatch.setattr(T, name, value)
    with open(PATH) as f:
        counter = T.Counter(f.read())
    texts = odd_texts(60, 8) + [x and x[:600] for x in LONG]
    assert counts(counter, texts) == library(texts)


def test_every_letter_by_itself_and_between_others(counter, library):
    points = [chr(p) for p in (*range(0x500), *range(0x1E00, 0x2200), *range(0x3000, 0x3100), *range(0xA000, 0x20000, 97)) if not 0xD800 <= p < 0xE000]
    texts = [f"{c} a{c}b .{c}. 1{c}'s" for c in points]
    assert counts(counter, texts) == library(texts)


def test_another_kind_of_file_is_refused():
    with pytest.raises(ValueError), open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        T.Counter(f.read())


def test_documents(docs, library, small, spark):
    rows = docs.collect()
    size = lambda x: len((x or "").encode())
    want = Multiset((r["doc_id"], size(r["text"]), n, n > 100) for r, n in zip(rows, library([r["text"] for r in rows]), strict=True))
    assert Multiset(tuple(r) for r in T.counted(docs, PATH, 100).collect()) == want
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = Multiset((r["doc_id"], size(r["text"]), n, n > 2048) for r, n in zip(rows, library([r["text"] for r in rows]), strict=True))
    assert Multiset(tuple(r) for r in Q.op12_token_counts(spark, small).collect()) == want


def test_no_documents(no_docs):
    assert T.counted(no_docs, PATH).collect() == []
