import pytest

from brightshelf.operators import facets, index, related, search, suggest
from brightshelf.plans import requests
from brightshelf.sources import catalog as C

ROWS = [
    {"id": "p1", "name": "Alfa Telefon 5G черный", "description": "Новый telefon с камерой", "price": 500.0, "old_price": 650.0, "category": "Телефоны", "brand": "Alfa", "params": {"color": "черный", "sim": "2"}},
    {"id": "p2", "name": "Alfa Pods 2 с USB-C", "description": "Беспроводные наушники", "price": 150.0, "category": "Наушники", "brand": "Alfa", "params": {"color": "белый"}},
    {"id": "p3", "name": "Beta WH-1000 черные", "description": "Лучшие наушники", "price": 300.0, "category": "Наушники", "brand": "Beta", "in_stock": False, "params": {"color": "черный"}},
    {"id": "p4", "name": "Gamma мышь", "description": "Беспроводная мышь", "price": None, "category": "Мыши", "brand": "Gamma", "params": {}},
]


@pytest.fixture(scope="module")
def shop(spark):
    cat = C.from_rows(spark, ROWS).cache()
    posted = index.postings(cat).cache()
    return cat, search.Index(posted, index.ngram_index(posted).cache())


@pytest.fixture(scope="module", autouse=True)
def one_job(spark):
    """Tiny tables: plans are not made anew stage by stage."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def run(spark, shop, q, limit=5, **kwargs):
    cat, idx = shop
    queries = requests.of_queries(spark, [q], limit)
    return [(r["id"], r["score"], r["total"]) for r in search.search(queries, idx, cat, **kwargs).orderBy("position").collect()]


def test_weights_add_up_and_ties_go_from_z_to_a(spark, shop):
    assert run(spark, shop, "наушники", 2) == [("p3", 2.5, 2), ("p2", 2.5, 2)]
    assert run(spark, shop, "alfa", 2) == [("p2", 5.0, 2), ("p1", 5.0, 2)]


def test_repeated_words_count_twice(spark, shop):
    assert run(spark, shop, "alfa alfa", 1)[0][1] == 10.0


def test_ngrams_fill_up_only_below_the_limit(spark, shop):
    assert [x[0] for x in run(spark, shop, "беспроводные", 1)] == ["p2"]
    more = run(spark, shop, "беспроводные", 5)
    assert [x[0] for x in more[:2]] == ["p2", "p4"] and more[1][1] < 0.5


def test_other_layout(spark, shop):
    # "мышь" typed with Latin keys loses nothing but its weight.
    assert run(spark, shop, "vsim", 1)[0][:2] == ("p4", round(4.0 * 0.9, 2))


def test_synonyms_of_the_first_group_only(spark, shop):
    groups = spark.createDataFrame([("demo", 0, ["сотовый", "Telefon"]), ("demo", 1, ["сотовый", "Pods"])], "project_id string, group_pos int, words array<string>")
    assert [x[0] for x in run(spark, shop, "сотовый", 1, synonyms=groups)] == ["p1"]


def test_no_tokens_no_rows(spark, shop):
    assert run(spark, shop, "и на !") == []


def test_stock_counts_only_where_products_are_read(spark, shop):
    assert [x[0] for x in run(spark, shop, "наушники", 2, facets=True)] == ["p2", "p3"]


def test_price_order_keeps_ties_and_null_is_zero(spark, shop):
    ids = [x[0] for x in run(spark, shop, "alfa gamma", 3, sort="price_asc")]
    assert ids[:3] == ["p4", "p2", "p1"]


def test_filters(spark, shop):
    assert [x[0] for x in run(spark, shop, "alfa", 1, filters={"params": {"color": ["белый"]}, "min_price": 100})] == ["p2"]
    assert search.overlaid({"category": "x"}, min_price=1, category="y", in_stock=None) == {"category": "x", "min_price": 1}



def test_pages_make_up_the_whole(spark, shop):
    whole = run(spark, shop, "alfa наушники", 4)
    pages = [x for k in range(4) for x in run(spark, shop, "alfa наушники", 4, offset=k)[:1]]
    assert [x[0] for x in whole] == [x[0] for x in pages]


def test_request_limits():
    assert search.request_limit(-1) == 10_000 and search.request_limit(None) == 50
    with pytest.raises(ValueError):
        search.request_limit(10_001)


def test_request_with_facets_and_related(spark, shop):
    cat, idx = shop
    out = requests.search_request(spark, idx, cat, {"q": "alfa наушники", "limit": 3, "facets": True, "related_fields": ["brand"], "filters": '{"max_price": 400}'})
    assert {r["id"] for r in out["items"].collect()} == {"p2", "p3"}
    bounds = out["price"].first()
    assert bounds["max"] == 500.0  # the price filter does not bound the slider
    assert sum(r["count"] for r in out["categories"].collect()) == out["items"].first()["total"]
    assert out["params"].columns == ["query_id", "key", "key_position", "value", "count", "value_position"]


def test_facets_by_chosen_fields(spark, shop):
    cat, idx = shop
    rows = facets.products(search.candidates(requests.of_queries(spark, ["alfa"], 1), idx), cat)
    assert facets.params(rows, fields=[]).count() == 0
    assert [r["key"] for r in facets.params(rows, fields=["sim", "color"]).orderBy("key_position", "value_position").collect()] == ["sim", "color", "color"]


def test_suggestions(spark, shop):
    idx = index.suggest_index(shop[0])
    assert [tuple(r) for r in suggest.suggest(idx, "ALFA ", 2).collect()] == [("alfa", 2), ("alfa telefon 5g черный", 1)]
    assert suggest.first_text(idx, "zzz") == "zzz"
    assert suggest.suggest_bucketed(idx.withColumn("prefix3", idx.prefix.substr(1, 3)), "a").count() == 0


def test_recommendations_fill_up_in_stages(spark, shop):
    clicks = spark.createDataFrame([("p3", 5), ("p1", 9)], "product_id string, clicks long")
    got = related.recommend(shop[0], clicks, limit=4, manual=["p4", "nope"], attributes={"brand": "alfa"}).orderBy("position").collect()
    assert [(r["id"], r["stage"]) for r in got] == [("p4", "manual"), ("p1", "attribute"), ("p2", "attribute"), ("p3", "popular")]


def test_writing_one_project_leaves_the_others(spark, tmp_path):
    a, b = C.from_rows(spark, ROWS[:1], "a"), C.from_rows(spark, ROWS[1:], "b")
    C.write(a.unionByName(b), str(tmp_path / "c"))
    C.write(C.from_rows(spark, ROWS[:2], "a"), str(tmp_path / "c"))
    assert C.read(spark, str(tmp_path / "c"), "a").count() == 2 and C.read(spark, str(tmp_path / "c"), "b").count() == 3
    index.write_index(a.unionByName(b), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).count() == index.postings(a.unionByName(b)).count()


def test_latest_of_equal_ids(spark):
    rows = spark.createDataFrame([("d", "1", "old", 1), ("d", "1", "new", 2)], "project_id string, id string, name string, ts int")
    assert C.latest(rows, "ts").first()["name"] == "new"


def test_the_last_of_equal_ids_without_an_order(spark):
    rows = spark.createDataFrame([("d", str(k % 50), k) for k in range(500)], "project_id string, id string, n int").coalesce(1)
    assert {r["id"]: r["n"] for r in C.latest(rows).collect()} == {str(k): 450 + k for k in range(50)}


def test_projects_do_not_mix(spark):
    """Two projects that share ids, and a change that names an id twice."""
    mine, theirs = C.from_rows(spark, ROWS, "a"), C.from_rows(spark, [{**r, "name": f"other {r['name']}", "price": 1.0, "category": "Else"} for r in ROWS], "b")
    both = mine.unionByName(theirs)
    idx = index.suggest_index(both)
    assert suggest.suggest(idx, "", 50, "a").collect() == suggest.suggest(index.suggest_index(mine), "", 50, "a").collect()
    assert facets.category_counts(both, "a").collect() == facets.category_counts(mine, "a").collect()
    assert facets.field_values(both, "brand", project_id="a").collect() == facets.field_values(mine, "brand", project_id="a").collect()
    assert [r["id"] for r in related.by_field(both, "brand", "alfa", project_id="a").collect()] == [r["id"] for r in related.by_field(mine, "brand", "alfa", project_id="a").collect()]
    posted = index.postings(both)
    whole = search.Index(posted, index.ngram_index(posted))
    hits = search.search(requests.of_queries(spark, ["alfa"], 20, "a"), whole, both)
    assert {r["name"] for r in hits.collect()} <= {r["name"] for r in ROWS}
    assert related.related_groups(hits, both, ["brand"], project_id="a").count() == related.related_groups(hits, mine, ["brand"], project_id="a").count()
    nobody = spark.createDataFrame([], "product_id string, clicks long")
    assert related.recommend(both, nobody, limit=9, project_id="a").count() == len(ROWS) - sum(r.get("in_stock") is False for r in ROWS)
    delta = spark.createDataFrame([("p1", 7.0, None, None, None), ("p1", 9.0, None, None, None)], "id string, price double, old_price double, in_stock boolean, quantity int").coalesce(1)
    after = index.merge_delta(both, delta, "a")
    assert after.count() == both.count()
    assert {(r["project_id"], r["price"]) for r in after.where("id = 'p1'").collect()} == {("a", 9.0), ("b", 1.0)}


def test_similar_tokens_are_looked_for_in_the_postings(spark, small):
    from brightshelf import queries

    # Known when the postings are planned, so that only theirs are joined.
    plan = queries.QUERIES["ngram_padded"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "anvil" in plan
