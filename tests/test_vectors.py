"""Stored vectors: cells, the cache of texts, collections, and searches of several tenants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightshelf.operators import cells, index, search, vectors
from brightshelf.plans import hybrid
from brightshelf.sources import catalog as C
from brightshelf.sources.snapshots import Snapshots


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    rows = [(k, (centres[k % 30] + rng.normal(size=24) * 0.6).tolist()) for k in range(3000)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23]
    df = spark.createDataFrame(rows + [(9000 + k, v) for k, v in enumerate(odd)], "id int, vector array<double>").repartition(3)
    path = str(tmp_path_factory.mktemp("cells"))
    cells.write(df, path, cells.fit(df))
    return rows, path


def exact(rows, v, k):
    m = np.array([x for _, x in rows])
    score = m @ v / np.linalg.norm(m, axis=1) / np.linalg.norm(v)
    return [rows[i][0] for i in np.lexsort(([r[0] for r in rows], -score))[:k]]


def test_recall_of_many_queries(spark, points):
    rows, path = points
    asks = [(k, rows[k][1]) for k in range(0, 3000, 40)]
    found = {}
    out = cells.search(spark, path, asks, 10)
    for r in out.collect():
        found.setdefault(r["query_id"], []).append((r["position"], r["id"], r["score"]))
    hits = 0
    for k, v in asks:
        got = sorted(found[k])
        assert [p for p, _, _ in got] == list(range(1, 11)) and got[0][1] == k and got[0][2] == pytest.approx(1.0)
        hits += len({i for _, i, _ in got} & set(exact(rows, np.array(v), 10)))
    assert hits / (10 * len(asks)) >= 0.95
    assert "crossJoin" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_all_cells_where_few_hold_enough(spark, points):
    rows, path = points
    v = np.random.default_rng(5).normal(size=24)
    got = cells.search(spark, path, [(1, v.tolist()), (2, [0.0] * 24), (3, None), (4, [float("nan")] * 24)], 2500, probed=0.01).collect()
    assert {r["query_id"] for r in got} == {1} and len(got) == 2500
    every = cells.search(spark, path, [(1, v.tolist())], 50, probed=1.0).orderBy("position").collect()
    assert [r["id"] for r in every] == exact(rows, v, 50)
    assert cells.search(spark, path, [], 3).collect() == []


def test_cells_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id int, vector array<double>")
    cells.write(none, str(tmp_path / "none"), cells.fit(none))
    assert cells.search(spark, str(tmp_path / "none"), [(1, [1.0])], 3).collect() == []


def test_texts_are_embedded_once(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    df = lambda *texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    run = lambda d, **k: vectors.embed_stored(d, F.col("text"), store, 8, **k)
    out, n = run(df("a", "b", "a", None))
    assert n == 3 and out.count() == 4
    want = {r["id"]: r["vector"] for r in vectors.embed(df("a", "b", "a", ""), F.col("text"), 8).collect()}
    assert {r["id"]: r["vector"] for r in out.collect()} == want
    assert run(df("b", "a"))[1] == 0
    assert run(df("b", "c"), drop=True)[1] == 1
    assert store.rows("vectors", store.version()).count() == 2
    assert run(df("a", "b", "c"))[1] == 1
    assert vectors.embed_stored(df("a"), F.col("text"), store, 4)[1] == 1  # of another length


def test_collections(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert vectors.create_collection(store, "c") and not vectors.create_collection(store, "c")
    assert store.rows("c", store.version()).count() == 0
    assert vectors.drop_collection(store, "c") and not vectors.drop_collection(store, "c")
    assert store.rows("c", store.version()) is None and vectors.create_collection(store, "c")


def test_tenants_that_share_ids(spark, tmp_path):
    rows = [{"id": str(k), "name": f"red ring {k}", "price": 1.0} for k in range(12)]
    mine, theirs = C.from_rows(spark, rows, "a"), C.from_rows(spark, [{**r, "name": f"blue gear {r['id']}"} for r in rows], "b")
    both = mine.unionByName(theirs)
    posted = index.postings(both)
    idx = search.Index(posted, index.ngram_index(posted))
    assert [r["name"] for r in C.by_ids(both, ["3", "x", "1"], "b").collect()] == ["blue gear 3", "blue gear 1"]
    page = C.page(both, 5, 0, "a").collect()
    assert len(page) == 5 and {r["total"] for r in page} == {12} and {r["project_id"] for r in page} == {"a"}
    words = spark.createDataFrame([("red", 5), ("ring", 5), ("blue", 5), ("gear", 5)], "word string, freq long")
    store = Snapshots(spark, str(tmp_path))
    for stored in (None, store, store):
        got = hybrid.hybrid_search(spark, "red ring", words, idx, both, 8, 0, 50, "a", stored).collect()
        assert len(got) == len({r["id"] for r in got}) == 12


def test_cells_are_written_once_and_asked_by_many_queries(spark, tmp_path):
    """One file a cell, however many tasks hold its vectors; scores are those of each with each, ties by id."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    x[600:] = x[:600]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<float>").repartition(6)
    path = str(tmp_path / "cells")
    cells.write(df, path, cells.fit(df))
    files = list((tmp_path / "cells" / "vectors").glob("cell=*/*.parquet"))
    assert len(files) == len({f.parent for f in files}) > 10
    got = cells.search(spark, path, [(k, v.tolist()) for k, v in enumerate(x)], 4, probed=1.0)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString() and "Generate" not in got._jdf.queryExecution().toString()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9)
    want = {(q, p, int(i)) for q in range(len(x)) for p, i in enumerate(np.lexsort((np.arange(len(x)), -near[q]))[:4], 1)}
    assert {(r["query_id"], r["position"], r["id"]) for r in got.collect()} == want


def test_products_of_equal_texts_are_scored_once(spark):
    df = spark.createDataFrame([(str(k), f"text {k % 5}") for k in range(40)], "id string, text string")
    query = vectors.mock_vector("text 3", 16).tolist()
    points = vectors.embed(df, F.col("text"), 16).select("id", "vector", F.create_map().cast("map<string,string>").alias("payload"))
    found = vectors.nearest_texts(df, F.col("text"), query, 12, 16)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in vectors.top_k(points, query, 12).collect()]
    scored = vectors.embed(df, F.col("text"), 16, of=lambda v: v)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
