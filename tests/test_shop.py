"""The stored shop: segments, versions, deltas, and the best results without whole postings."""

import random

import pytest
from pyspark.sql import functions as F

from brightshelf.operators import impact, index, search
from brightshelf.plans import requests, rich
from brightshelf.plans.shop import SEGMENTS, Shop, tick
from brightshelf.sources import catalog as C
from brightshelf.sources.snapshots import Conflict, Snapshots

WORDS = ["red", "blue", "ring", "gear", "bolt", "steel", "small"]


def products(spark, n=60, project="demo", seed=1):
    rng = random.Random(seed)
    rows = [{"id": str(k), "name": " ".join(rng.sample(WORDS, 3)), "price": 10.0 + k % 7, "category": "tools", "brand": rng.choice(["Alfa", "Beta"]), "in_stock": k % 4 > 0} for k in range(n)]
    return C.from_rows(spark, rows, project)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def state(shop):
    idx = shop.index()
    return rows_of(idx.postings, "project_id", "token", "product_id", "score"), rows_of(idx.ngrams, "project_id", "ngram", "token"), rows_of(shop.suggestions(), "project_id", "prefix", "freq")


def rebuilt(cat, kind="plain"):
    posted = index.postings(cat) if kind == "plain" else index.placed_postings(cat)
    return rows_of(posted, "project_id", "token", "product_id", "score"), rows_of(index.suggest_index(cat), "project_id", "prefix", "freq")


@pytest.fixture(scope="module", autouse=True)
def one_job(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_segments_read_like_a_rebuild(spark, tmp_path):
    shop, cat = Shop(spark, str(tmp_path)), products(spark)
    assert shop.catalog().collect() == [] and shop.index().postings.collect() == []
    shop.replace(cat, "demo")
    shop.replace(products(spark, 9, "other", 5), "other")
    changed = products(spark, 12, seed=3).unionByName(C.from_rows(spark, [{"id": "new", "name": "new thing"}])).unionByName(C.from_rows(spark, [{"id": "3", "name": "theirs"}], "other"))
    shop.upsert(changed)
    shop.delete(cat.where("id in ('5', '50')"))
    now = cat.join(changed.select("project_id", "id"), ["project_id", "id"], "left_anti").unionByName(changed)
    now = now.unionByName(products(spark, 9, "other", 5).where("id <> '3'")).where("not (project_id = 'demo' and id in ('5', '50'))")
    posted, ngrams, suggested = state(shop)
    assert (posted, suggested) == rebuilt(now)
    # Tokens that no product has any more may still be among the n-grams, where they find nothing.
    assert set(ngrams) >= set(rows_of(index.ngram_index(index.postings(now)), "project_id", "ngram", "token"))
    assert len(ngrams) == len(set(ngrams))
    shop.compact()
    assert state(shop)[0] == posted and state(shop)[2] == suggested
    assert len(shop.version()["tables"]["postings"]) == 1 and shop.version()["tables"]["gone"] == []
    shop.clear("other")
    assert {r[0] for r in state(shop)[0]} == {"demo"} and {r[0] for r in state(shop)[2]} == {"demo"}


@pytest.mark.parametrize("kind", ["plain", "rich"])
def test_a_search_after_a_delta_is_that_of_a_rebuilt_index(spark, tmp_path, kind):
    shop, cat = Shop(spark, str(tmp_path), kind), products(spark)
    shop.replace(cat, "demo")
    updates = spark.createDataFrame([("4", None, "true", None), ("5", "99", "false", None), ("8", None, "yes", "3"), ("9", "9", None, None), ("77", "1", None, None)], "id string, price string, available string, quantity string")
    log = shop.delta(updates, "demo").first()
    assert (log["processed"], log["updated"]) == (5, 3 + (cat.where("id = '9' and price <> 9").count()))
    written = sum(spark.read.parquet(f"{tmp_path}/{p['path']}").count() for p in shop.version()["tables"]["catalog"][1:])
    assert written == log["updated"]
    after = shop.catalog()
    assert {r["id"]: (r["price"], r["in_stock"]) for r in after.where("id in ('4', '5', '8')").collect()} == {"4": (14.0, True), "5": (99.0, False), "8": (11.0, True)}
    assert state(shop)[0] == rebuilt(after, kind)[0]
    if kind == "rich":
        pop = spark.createDataFrame([], "id string, popularity double")
        asked = requests.of_queries(spark, ["red ring", "alfa"], 20)
        page = lambda idx: rows_of(rich.rich_search(asked, idx, after, pop), "query_id", "position", "id", "final")
        assert page(shop.index()) == page(rich.build(after))


def test_restock_computes_scores_anew(spark):
    cat = products(spark)
    after = cat.withColumn("in_stock", F.when(F.col("id") == "4", True).when(F.col("id") == "5", False).otherwise(F.col("in_stock")))
    got = index.restocked(index.placed_postings(cat), cat, after, index.placed_postings)
    assert rows_of(got.where("product_id <> '5'"), "token", "product_id", "score") == rows_of(index.placed_postings(after).where("product_id <> '5'"), "token", "product_id", "score")
    assert rows_of(got.where("product_id = '5'"), "token", "score") == sorted((t, s / 2) for t, s in rows_of(index.placed_postings(cat).where("product_id = '5'"), "token", "score"))
    # Where scores do not depend on stock, what comes back has what a rebuild gives it.
    plain = index.restocked(index.postings(cat), cat, after)
    assert rows_of(plain.where("product_id = '4'"), "token", "score") == rows_of(index.postings(cat).where("product_id = '4'"), "token", "score")


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    shop = Shop(spark, str(tmp_path))
    shop.replace(products(spark), "demo")
    before, number = state(shop), shop.version()["number"]
    for dies_at in ("postings", "ngrams", "gone"):
        write = Snapshots.write

        def dying(self, df, table, order=None, dies_at=dies_at, write=write):
            if table == dies_at:
                raise OSError("the run dies")
            return write(self, df, table, order)

        monkeypatch.setattr(Snapshots, "write", dying)
        with pytest.raises(OSError):
            shop.replace(products(spark, 5, seed=9), "demo")
        monkeypatch.undo()
        assert Shop(spark, str(tmp_path)).version()["number"] == number and state(shop) == before and shop.catalog().count() == 60
    assert shop.saved.vacuum() > 0 and state(shop) == before


def test_versions(spark, tmp_path):
    shop = Shop(spark, str(tmp_path))
    base = shop.version()
    first = shop.replace(products(spark, 8), "demo")
    second = shop.upsert(C.from_rows(spark, [{"id": "0", "name": "another", "price": 1.0}]))
    assert (first, second) == (1, 2) and shop.saved.versions() == [1, 2]
    assert shop.catalog(shop.version(1)).where("name = 'another'").isEmpty() and not shop.catalog().where("name = 'another'").isEmpty()
    with pytest.raises(Conflict):
        shop.saved.publish(base, {})
    shop.compact()
    shop.saved.vacuum(1)
    assert shop.saved.versions() == [3] and shop.catalog().count() == 8
    for k in range(SEGMENTS):
        shop.upsert(C.from_rows(spark, [{"id": f"x{k}", "name": "thing", "price": 1.0}]))
    assert len(shop.version()["tables"]["postings"]) == 1 and shop.catalog().count() == 8 + SEGMENTS


def test_recovery(spark, tmp_path):
    shop = Shop(spark, str(tmp_path))
    shop.replace(products(spark, 6), "demo")
    backup = C.to_backup(products(spark, 4, "lost"))
    projects = spark.createDataFrame([("demo",), ("lost",), ("empty",)], "project_id string")
    done = {r["project_id"]: r["step"] for r in shop.recover(backup, projects).collect()}
    assert done == {"demo": "none", "lost": "restore", "empty": "none"}
    assert rows_of(shop.catalog().groupBy("project_id").count(), "project_id", "count") == [("demo", 6), ("lost", 4)]
    assert {r[0] for r in state(shop)[0]} == {"demo", "lost"}


def test_cuts():
    # The frequent token is never read: what it adds cannot lift a product over those of the rare one.
    blocks = {"rare": [(5.0, 5.0, 30)], "all": [(2.0, 2.0, 10_000)]}
    assert impact.cuts({"rare": 1, "all": 1}, blocks, 20) == (5.0, {"rare": 1, "all": 0})
    assert impact.cuts({"rare": 1, "all": 1}, blocks, 31)[1]["all"] == 1
    assert impact.cuts({"all": 2}, {"all": [(3.0, 3.0, 5), (2.0, 1.5, 50), (1.0, 1.0, 900)]}, 20) == (3.0, {"all": 2})
    assert impact.cuts({"none": 1}, {}, 1) is None and impact.cuts({"rare": 1}, blocks, 31) is None


def plan_rows(df):
    """Rows that the scans of a plan that has run put out."""
    plan, found, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        p = todo.pop()
        if "Scan parquet" in p.nodeName():
            found += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """One word that all products have, and others in a few hundred."""
    rng = random.Random(4)
    rows = [{"id": f"{k:05d}", "name": f"w{rng.randrange(90)} w{rng.randrange(90)}" + " rare" * (k % 140 == 0), "category": "common", "price": 1.0} for k in range(4000)]
    shop = Shop(spark, str(tmp_path_factory.mktemp("large")))
    shop.replace(C.from_rows(spark, rows), "demo")
    return shop


QUERIES = ["rare common", "w1 common", "common", "w1 w2", "w1 w1 w3 common", "w4 rare common", "nothing", "common nothing", "w5", ""]


@pytest.mark.parametrize("limit, offset", [(20, 0), (5, 0), (3, 4), (60, 0)])
def test_the_best_are_those_of_a_whole_search(spark, large, limit, offset):
    asked, cat = requests.of_queries(spark, QUERIES, limit), large.catalog()
    want = rows_of(search.search(asked, large.index(), cat, offset), "query_id", "position", "id", "score")
    assert rows_of(impact.top(asked, large.impacts(), cat, offset), "query_id", "position", "id", "score") == want


def test_rows_read(spark, large):
    idx = large.impacts()
    rows = [r.asDict() for r in search.prepared(requests.of_queries(spark, ["rare common"], 20)).collect()]
    served, others, postings = impact.planned(rows, idx)
    assert len(served) == 1 and not others
    postings.collect()
    every = search.of_tokens(idx.blocks, {("demo", "rare"), ("demo", "common")}).count()
    assert every > 4000 and postings.count() < 0.05 * every


def test_the_best_of_several_segments(spark, tmp_path):
    shop, cat = Shop(spark, str(tmp_path)), products(spark, 120)
    shop.replace(cat, "demo")
    shop.upsert(products(spark, 30, seed=8))
    shop.delete(cat.where("id in ('40', '41', '42')"))
    assert shop.impacts().gone == 33
    asked = requests.of_queries(spark, ["red ring tools", "alfa tools", "gear", "steel bolt alfa"], 7)
    now = shop.catalog()
    posted = index.postings(now)
    want = rows_of(search.search(asked, search.Index(posted, index.ngram_index(posted)), now), "query_id", "position", "id", "score")
    assert rows_of(impact.top(asked, shop.impacts(), now), "query_id", "position", "id", "score") == want


def test_a_tick_that_runs_twice_changes_nothing(spark, tmp_path):
    folder = tmp_path / "feeds"
    folder.mkdir()
    for name, price in (("a1", 5), ("a2", 7), ("b1", 9)):
        (folder / f"{name}.csv").write_text(f"id,name,url,price\n1,Red ring,u,{price}\n2,,u,3\n")
    (tmp_path / "files").mkdir()
    lines = [("a", "a1", 1), ("a", "a2", 2), ("b", "b1", 1), ("c", "b1", 1)]
    spark.createDataFrame([(p, str(folder / f"{n}.csv"), "csv", t) for p, n, t in lines], "project_id string, path string, kind string, read_at int").write.parquet(str(tmp_path / "files" / "f"))
    projects = spark.createDataFrame([("a", "http://a"), ("b", "http://b"), ("c", "")], "project_id string, feed_url string")
    files = lambda: spark.readStream.schema("project_id string, path string, kind string, read_at int").parquet(str(tmp_path / "files" / "f"))
    shop = Shop(spark, str(tmp_path / "shop"))
    tick(shop, files(), projects, "2024-01-01 12:00:00", str(tmp_path / "p1")).awaitTermination()
    assert rows_of(shop.catalog(), "project_id", "id", "price") == [("a", "1", 7.0), ("b", "1", 9.0)]
    log = shop.saved.rows("log", shop.version())
    assert rows_of(log, "project_id", "batch", "processed", "errors") == [("a", 0, 1, 1), ("b", 0, 1, 1)]
    number = shop.version()["number"]
    # The stream's progress is lost, so the batch comes again with its number.
    tick(shop, files(), projects, "2024-01-02 12:00:00", str(tmp_path / "p2")).awaitTermination()
    assert shop.version()["number"] == number


def test_products_alike_are_ranked_once(spark, tmp_path):
    rows = [{"id": f"{k:03d}", "name": ("red ring", "red gear", "blue ring")[k % 3], "category": "tools", "vendor_code": f"PN-{k}", "price": 1.0} for k in range(300)]
    shop = Shop(spark, str(tmp_path))
    shop.replace(C.from_rows(spark, rows), "demo")
    asked, idx = requests.of_queries(spark, ["red ring", "red gear", "ring", "red tools"], 5), shop.impacts()
    tokens = {("demo", t) for t in ("red", "ring", "gear", "tools")}
    kept = search.best_alike(idx.index().postings, tokens, 7)
    assert sorted(r[0] for r in kept.select("product_id").distinct().collect()) == [f"{k:03d}" for k in range(279, 300)]
    want = rows_of(search.search(asked, idx.index(), shop.catalog(), 2), "query_id", "position", "id", "score")
    assert len(want) == 20 and rows_of(impact.top(asked, idx, shop.catalog(), 2), "query_id", "position", "id", "score") == want


def test_dear_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(k):
        made.add(1)
        return k

    saved = Snapshots(spark, str(tmp_path))
    part = saved.part(saved.write_once(spark.range(0, 100, 1, 4).select(F.udf(counted, "long")("id").alias("k")), "rows", [F.desc("k")]))
    assert sorted(r["k"] for r in part.collect()) == list(range(100)) and made.value == 100
    assert len(list((tmp_path / "parts").iterdir())) == 1
