"""Vector codes against a plain version in Python's integers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from brightshelf.llm import codebooks as B
from brightshelf.llm import queries as Q

ORDER = lambda v: (v is None, v or 0)


def plainly(rows):
    """``rows``: (vec_id, vector, label), all of one length."""
    fit = [(i, v, y) for i, v, y in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    fit.sort(key=lambda r: (*ORDER(r[0]), [float(x) for x in r[1]]))
    whole = [[math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in v] for _, v, _ in fit]
    w = len(whole[0]) // 16
    cut = [[v[p * w : p * w + w] for p in range(16)] for v in whole]
    books = [[c[p] for c in cut[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda c, book: min((far(c, e), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            of = defaultdict(list)
            for c in cut:
                of[best(c[p], books[p])[1]].append(c[p])
            for k, parts in of.items():
                books[p][k] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
    out, errors = [], defaultdict(int)
    for (i, _, y), c in zip(fit, cut, strict=True):
        found = [best(c[p], books[p]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
        errors[y] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    long = lambda n: n if n < 1 << 63 else None
    return Counter((i, code, long(e), long(errors[y]), sha) for i, code, e, y in out)


def rows_of(rng, n, width=32, spread=1.0):
    centres = rng.normal(size=(9, width)) * spread
    return [(k * 7 % 1009, (centres[k % 9] + rng.normal(size=width) * 0.3).astype(np.float32).tolist(), [None, 3, 3, 3, 5][k % 5]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", -1, "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, part int, of string").repartition(3)


def got(spark, rows):
    return Counter(tuple(r) for r in B.compressed(frame(spark, rows)).collect())


@pytest.mark.parametrize("n", [1, 40, 700])
def test_codes(spark, n):
    rows = rows_of(np.random.default_rng(n), n)
    assert got(spark, rows) == plainly(rows)


def test_ties_repeats_and_what_is_left_out(spark):
    rng = np.random.default_rng(2)
    # Few values, so that many entries are equal or equally far.
    rows = [(k // 2, rng.integers(-2, 3, size=16).astype(float).tolist(), k % 3) for k in range(300)]
    rows += rows[:20] + [(None, rows[5][1], None), (None, rows[6][1], 1)]
    odd = [None, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15]
    bad = [(-9 - k, v, 0) for k, v in enumerate(odd)]
    assert got(spark, rows + bad) == plainly(rows + bad)
    assert got(spark, [*rows, (900, [1.0] * 15, 0), (901, [], 0), (902, [1.0] * 32, 0)]) == plainly(rows)
    assert got(spark, bad) == Counter() and got(spark, []) == Counter()


def test_huge_components(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=16) * 10.0 ** rng.choice([-30, 0, 5, 12, 30])).tolist(), k % 2) for k in range(150)]
    assert got(spark, rows) == plainly(rows)
    rows = [(k, (rng.normal(size=16) * 1e9).tolist(), k % 2) for k in range(90)]
    assert got(spark, rows) == plainly(rows)


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_ROWS", 1)
    rows = rows_of(np.random.default_rng(5), 200)
    assert got(spark, rows) == plainly(rows)


@pytest.mark.parametrize("kind", ["spread", "grid", "large"])
def test_balls_find_the_lowest_of_the_nearest(kind):
    rng = np.random.default_rng(6)
    make = {"spread": lambda n: rng.integers(-300, 300, size=(n, 4)), "grid": lambda n: rng.integers(-2, 3, size=(n, 3)), "large": lambda n: rng.integers(-(1 << 26), 1 << 26, size=(n, 4))}[kind]
    for k in (1, 2, 5, 64, 200):
        entries, points = make(k), make(500)
        index, far = B.Balls(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (far == every.min(1)).all() and (index == every.argmin(1)).all()


def test_most_balls_are_not_visited():
    rng = np.random.default_rng(7)
    centres = rng.integers(-5000, 5000, size=(16, 4))
    entries = np.concatenate([centres + rng.integers(-20, 20, size=(16, 4)) for _ in range(4)])
    compared = 0

    class Counting(B.Balls):
        def _compare(self, members, points, rows, best, index):
            nonlocal compared
            compared += len(members) * len(rows)
            super()._compare(members, points, rows, best, index)

    points = centres[rng.integers(0, 16, size=1000)] + rng.integers(-20, 20, size=(1000, 4))
    Counting(entries).nearest(points)
    assert compared < 0.4 * len(points) * len(entries)


def test_decoded(spark):
    rows = rows_of(np.random.default_rng(8), 300)
    kept = B.kept(frame(spark, rows))
    books = B.fitted(kept)
    of = {i: v for i, v, _ in rows}
    for r in B.decoded(B.encoded(kept, books), books).collect():
        whole = np.floor(np.array(of[r["vec_id"]]) * 256)
        assert round(((np.array(r["approximation"]) * 256 - whole) ** 2).sum()) == r["error"]


def test_the_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(tuple(r) for r in Q.op11_vector_codes(spark, small).collect()) == plainly(rows)
