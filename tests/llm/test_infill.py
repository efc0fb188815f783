"""Fill-in-the-middle against a plain version, and its way back."""

import hashlib
import re
from collections import Counter

import pytest

from brightshelf.llm import infill
from brightshelf.llm import queries as Q

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
MARKS = ("<P>", "<S>", "<M>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    key = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if text == "" or any(x in text for x in MARKS) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


ODD = ["a<P>b", "<M>", "<S", "P>x", "<", ">", "<<S><", "\n\n", "a\r\nb", "🙂é🙂", "é", "ſß", "\0", "a" * 50_000, "é " * 30_000, "$1 \\1 a.b*", "<PSM>", "< P >"]


def test_arrangements(spark, docs):
    more = spark.createDataFrame([(10_000 + 7 * k + j, t) for k, t in enumerate(ODD) for j in range(7)], "doc_id long, text string")
    every = docs.unionByName(more, allowMissingColumns=True)
    want = Counter(plainly(r["doc_id"], r["text"]) for r in every.collect())
    assert Counter(tuple(r) for r in infill.digests(every).collect()) == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_what_is_read_back(spark, docs):
    back = infill.restored(infill.arranged(docs)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    wrong = spark.createDataFrame([("psm", "<S>a<P>b<M>c"), ("spm", "<S>a<P>b"), ("psm", "x<P>a<S>b<M>c"), ("psm", "<P>a<S>b<M>c<M>"), ("psm", None), (None, "a")], "form string, output string")
    assert [r["text"] for r in infill.restored(wrong).collect()] == [None] * 6


def test_rates_and_seeds(docs):
    forms = lambda **k: Counter(r["form"] for r in infill.arranged(docs.where("length(text) > 0"), **k).collect())
    assert set(forms(rate=0)) == {"plain"}
    assert "psm" not in forms(rate=100, suffix_first=100) and "spm" not in forms(rate=100, suffix_first=0)
    assert infill.arranged(docs, seed=2).exceptAll(infill.arranged(docs)).count() > 0


def test_nothing_to_arrange(no_docs):
    assert infill.digests(no_docs).collect() == []


@pytest.mark.parametrize("column", ["n", "form"])
def test_the_query(spark, small, column):
    rows = Q.op13_fill_in_middle(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count() and all(r[column] is not None for r in rows)
