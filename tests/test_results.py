"""Kept pages, and facets by one pass."""

import pytest

from brightshelf.operators import facets, search
from brightshelf.plans import requests
from brightshelf.plans import results as R
from brightshelf.plans.shop import Shop
from brightshelf.sources import catalog as C
from brightshelf.sources.snapshots import Snapshots

ROWS = [{"id": str(k), "name": f"{('red', 'blue')[k % 2]} ring {k}", "price": float(k % 9), "category": ["Rings", "Other", None, ""][k % 4], "params": {"size": str(k % 3), "hue": f"h{k % 5}", "sku": str(k)}} for k in range(40)]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    made = Shop(spark, str(tmp_path_factory.mktemp("shop")))
    made.replace(C.from_rows(spark, ROWS), "demo")
    return made


def rows_of(df):
    return sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))


def test_the_second_batch_is_not_searched(spark, shop, tmp_path, monkeypatch):
    now = [1000.0]
    results = R.Results(Snapshots(spark, str(tmp_path)), 300, lambda: now[0])
    batch = requests.of_queries(spark, ["red ring", "blue", "nothing at all", "red ring"], 5)
    want = rows_of(search.search(batch, shop.index(), shop.catalog()))
    assert rows_of(results.search(shop, batch)) == want
    with monkeypatch.context() as m:
        m.setattr(R.search, "search", None)
        assert rows_of(results.search(shop, batch)) == want
        assert rows_of(results.search(shop, requests.of_queries(spark, ["blue"], 5))) == rows_of(results.search(shop, requests.of_queries(spark, ["blue"], 5)))
    searched = []
    plain = search.search
    monkeypatch.setattr(R.search, "search", lambda queries, *a, **k: searched.append([r["q"] for r in queries.collect()]) or plain(queries, *a, **k))
    results.search(shop, requests.of_queries(spark, ["blue", "red"], 5))
    results.search(shop, requests.of_queries(spark, ["blue"], 6))
    results.search(shop, requests.of_queries(spark, ["blue"], 5), filters={"in_stock": True})
    results.search(shop, requests.of_queries(spark, ["blue"], 5), sort="price_asc")
    assert searched == [["red"], ["blue"], ["blue"], ["blue"]]
    now[0] += 301
    assert rows_of(results.search(shop, batch)) == want and len(searched[-1]) == 3
    assert results.evict(shop) == 3 and rows_of(results.search(shop, batch)) == want and len(searched) == 5
    shop.upsert(C.from_rows(spark, [{"id": "new", "name": "blue blue blue", "price": 1.0}]))
    assert "new" in {r["id"] for r in results.search(shop, requests.of_queries(spark, ["blue"], 5)).collect()}


@pytest.mark.parametrize("fields", [None, ["hue", "size"], []])
def test_facets_by_one_pass(spark, shop, fields):
    filters = {"min_price": 1.0, "max_price": 6.0}
    rows = facets.products(search.candidates(requests.of_queries(spark, ["ring", "red", "nothing"], 50), shop.index()), shop.catalog(), filters)
    every = facets.together(rows, filters, fields).cache()
    assert rows_of(every.where("facet = 'category'").select("query_id", "value", "count", "position")) == rows_of(facets.categories(rows, filters))
    assert rows_of(every.where("facet = 'price'").select("query_id", "min", "max")) == rows_of(facets.price_bounds(rows))
    params = facets.params(rows, filters, fields).withColumnRenamed("value_position", "position")
    assert rows_of(every.where("facet = 'param'").select("query_id", "key", "key_position", "value", "count", "position")) == rows_of(params)
