from brightshelf.plans import feed_runs
from brightshelf.sources import catalog


def test_full_and_delta_runs(spark, tmp_path):
    raw = spark.createDataFrame(
        [("1", "Red ring", "u", "10", "yes", None), ("2", "Blue bolt", "u", "20", None, None), ("2", "", "u", "1", None, None)], "id string, name string, url string, price string, in_stock string, quantity string"
    )
    row = feed_runs.full(spark, raw, str(tmp_path), "shop").first()
    assert (row["processed"], row["errors"]) == (2, 1)
    updates = spark.createDataFrame([("1", "12,5", "no"), ("9", "1", None)], "id string, price string, available string")
    log = feed_runs.delta(spark, updates, str(tmp_path), "shop").first()
    assert (log["processed"], log["updated"]) == (2, 1)
    got = {r["id"]: (r["price"], r["in_stock"]) for r in catalog.read(spark, f"{tmp_path}/catalog", "shop").collect()}
    assert got == {"1": (12.5, False), "2": (20.0, True)}
