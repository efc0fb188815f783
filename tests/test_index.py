"""How an index is made: by as many tasks as there are products for."""

from brightshelf.operators import index
from brightshelf.sources import catalog


def test_postings_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(index, "PRODUCTS_EACH", 100, raising=False)
    rows = [{"id": str(k % 950), "name": f"red n{k}", "brand": "b"} for k in range(1000)]
    posted = index.postings(catalog.from_rows(spark, rows).coalesce(1))
    assert posted.rdd.getNumPartitions() == 11
    # Rows that share an id are one product, as they were.
    assert {tuple(r) for r in posted.where("token = 'red'").groupBy("score").count().collect()} == {(3.0, 900), (6.0, 50)}
    # Products are shuffled, their postings are not.
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "token" in line]


def long_text() -> str:
    """A description of some 9000 characters: the 500th stands within a word, and one word comes at the end alone."""
    return " ".join(["zebra-n1"] + [f"word{k:04}" for k in range(1000)] + ["zebra-n1", "ultima"])


def test_postings_hold_whole_descriptions(spark):
    posted = index.postings(catalog.from_rows(spark, [{"id": "1", "name": "ultima", "description": long_text()}]))
    want = {f"word{k:04}": 1.0 for k in range(1000)} | {"zebra-n1": 2.0, "zebran1": 1.0, "zebra": 1.0, "n1": 1.0, "ultima": 4.0}
    assert {r["token"]: r["score"] for r in posted.collect()} == want


def test_tasks_follow_the_length_of_descriptions(spark, monkeypatch):
    monkeypatch.setattr(index, "BYTES_EACH", 10_000, raising=False)
    rows = [{"id": str(k), "name": "red", "description": "x" * 10_000 if k % 2 else None} for k in range(10)]
    assert index.postings(catalog.from_rows(spark, rows)).rdd.getNumPartitions() == 6


def test_top_tokens_count_whole_descriptions(spark):
    rows = [{"id": str(k), "name": f"n{k}", "description": f"{long_text()} d{k}"} for k in range(3)]
    rows.append({"id": "3", "name": "ultima"})
    top = index.token_document_counts(index.postings(catalog.from_rows(spark, rows)), 3).collect()
    assert [tuple(r) for r in top] == [("ultima", 4), ("n1", 3), ("word0000", 3)]


def test_changed_products_are_indexed_whole(spark):
    whole = catalog.from_rows(spark, [{"id": "1", "name": "a1", "description": long_text()}, {"id": "2", "name": "b2", "description": long_text()}])
    changed = catalog.from_rows(spark, [{"id": "2", "name": "b2", "description": long_text() + " postrema"}])
    after = index.upsert(index.postings(whole), changed)
    assert {tuple(r) for r in after.where("token IN ('ultima', 'postrema')").select("token", "product_id").collect()} == {("ultima", "1"), ("ultima", "2"), ("postrema", "2")}
