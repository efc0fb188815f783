import os
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from brightshelf.operators import analytics, spell, vectors
from brightshelf.plans import feed_runs
from brightshelf.sources import catalog, feeds
from brightshelf.streaming import counters

YML = """<yml_catalog><shop><name>S</name><company>C</company><url>u</url>
<categories><category id="1">Phones</category><category id="2" parentId="1">Cases &amp; more</category></categories>
<offers>
<offer id="a" available="TRUE"><name>One &amp;quot;x&amp;quot;</name><price>10.5</price><oldprice>20</oldprice><categoryId>2</categoryId><picture>p1</picture><picture>p2</picture><param name="c">red</param><param name="c">blue</param></offer>
<offer id="b" available="false"><typePrefix>Case</typePrefix><vendor>V</vendor><model>M1</model><price>much</price><categoryId>9</categoryId></offer>
<offer><name>nameless id</name></offer>
</offers></shop></yml_catalog>"""


def test_yml(spark, tmp_path):
    path = tmp_path / "feed.xml"
    path.write_text(YML)
    rows = {r["id"]: r for r in feeds.read_yml(spark, str(path)).collect()}
    assert set(rows) == {"a", "b"}
    a, b = rows["a"], rows["b"]
    assert (a["name"], a["price"], a["old_price"], a["in_stock"], a["category"], a["image"], a["params"]) == ('One "x"', 10.5, 20.0, True, "Cases & more", "p1", {"c": "blue"})
    assert (b["name"], b["price"], b["in_stock"], b["category"], b["currency"]) == ("Case V M1", 0.0, False, "", "RUB")
    assert feeds.yml_shop(spark, str(path)).first()["company"] == "C"


def test_other_feeds(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"items": [{"id": 1, "title": "T", "price": "1 000,5"}, {"title": "no id"}]}')
    (tmp_path / "f.csv").write_text("id,name,price,available\n7,N,5,yes\n,M,1,no\n")
    got = feeds.transformed(feeds.read_json(spark, str(tmp_path / "f.json"))).collect()
    assert [(r["id"], r["name"], r["price"], r["in_stock"]) for r in got] == [("1", "T", 1000.5, True)]
    got = feeds.transformed(feeds.read_csv(spark, str(tmp_path / "f.csv"))).collect()
    assert [(r["id"], r["in_stock"]) for r in got] == [("7", True)]
    assert [feeds.sniff(x) for x in (" <a/>", "[1]", "a,b")] == ["xml", "json", "xml"] and feeds.sniff("a,b", "csv") == "csv"


def test_feeds_of_any_format(spark, tmp_path):
    write = lambda name, text, encoding="utf-8": ((tmp_path / name).write_bytes(text.encode(encoding)), str(tmp_path / name))[1]
    mixed = write("m.xml", '<yml_catalog><offer id="1"><name>A</name><price>5</price><param name="c">red</param><param name="c">blue</param><param name="e"/></offer><item id="2"><title>B</title><price>6</price><param name="s">L</param></item><entry><id>3</id><name>C</name><price>1</price></entry></yml_catalog>')
    rows = {r["id"]: r for r in feeds.transformed(feeds.read(spark, mixed)).collect()}
    assert {k: (r["name"], r["params"]) for k, r in rows.items()} == {"1": ("A", {"c": "blue"}), "2": ("B", {"s": "L"}), "3": ("C", {})}
    google = write("g.xml", "<feed xmlns:g='http://base.google.com/ns/1.0'><entry><g:id>9</g:id><g:title>G</g:title><g:price>7 RUB</g:price><g:availability>no</g:availability></entry></feed>")
    assert [(r["id"], r["name"], r["price"], r["in_stock"]) for r in feeds.transformed(feeds.read(spark, google)).collect()] == [("9", "G", 7.0, False)]
    russian = write("r.csv", "id,name,price\n1,Мышь,10\n", "cp1251")
    assert [r["name"] for r in feeds.read(spark, russian, "csv").collect()] == ["Мышь"]
    assert [r["name"] for r in feeds.read(spark, write("u.csv", "id,name\n1,Мышь\n"), "csv").collect()] == ["Мышь"]
    updates = write("d.xml", '<u><item id="1" available="yes"><price>1 299,90</price><quantity>3</quantity></item><offer id="2"><in_stock>no</in_stock></offer><product><price>1</price></product></u>')
    got = {r["id"]: (r["price"], r["in_stock"], r["quantity"]) for r in feeds.read_delta(spark, updates).collect()}
    assert got == {"1": (1299.9, True, 3), "2": (None, False, None)}
    updates = write("d.json", '{"items": [{"id": 1, "price": 5.5, "oldprice": 9, "available": true}, {"price": 1}]}')
    assert [tuple(r) for r in feeds.read_delta(spark, updates).collect()] == [("1", 5.5, 9.0, True, None)]


def test_recovery_restores_and_rebuilds(spark, tmp_path):
    path = str(tmp_path / "shop")
    raw = spark.createDataFrame([("1", "Red ring", "u", "5"), ("2", "Blue gear", "u", "6")], "id string, name string, url string, price string")
    log = feed_runs.full(spark, raw, path, "a").first()
    assert (log["processed"], log["updated"]) == (2, 2) and log["duration_ms"] > 0
    rows = catalog.read(spark, f"{path}/catalog", "a")
    catalog.to_backup(rows.withColumn("project_id", F.lit("b"))).write.parquet(f"{path}/backup")
    catalog.write(rows.withColumn("project_id", F.lit("c")), f"{path}/catalog")
    projects = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "project_id string")
    assert {r["project_id"]: r["step"] for r in feed_runs.recover(spark, path, projects).collect()} == {"a": "none", "b": "restore", "c": "rebuild", "d": "none"}
    posted = spark.read.parquet(f"{path}/index/postings").groupBy("project_id").count().collect()
    assert len({r["count"] for r in posted}) == 1 and {r["project_id"] for r in posted} == {"a", "b", "c"}


def test_validation(spark):
    raw = spark.createDataFrame([("1", "a", "u", "5"), (None, "b", "u", "1.2.3")], "id string, name string, url string, price string")
    good, bad = feeds.validated(raw)
    assert good.count() == 1 and bad.first()["errors"] == ["missing id", "invalid price"]


def test_report_windows(spark):
    log = spark.createDataFrame([("2024-01-01 10:00:00", "a  B", 1, 5.0), ("2024-01-03 10:00:00", "x", 1, 7.0), ("2024-01-03 11:00:00", "a b", 0, 9.0)], "ts string, query string, results_count int, took_ms double").withColumn("ts", F.col("ts").cast("timestamp"))
    clicks = log.select("ts", F.lit("p").alias("product_id"), "query")
    out = analytics.report(log, clicks, date(2024, 1, 3), 3)
    assert [r["count"] for r in out["queries_by_day"].orderBy("day").collect()] == [1, 0, 1]  # one-character queries do not count
    assert tuple(out["totals"].first()) == (2, 3)
    assert [tuple(r) for r in out["popular_queries"].collect()] == [("a b", 1)]


def test_streams_equal_batches(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = counters.counts(counters.read_events(spark, f"{small}/events.parquet"), "1 hour")
    got = counters.to_table(stream)
    assert got.agg(F.sum("count")).first()[0] == events.count()
    sessions = counters.to_table(counters.sessions(counters.read_events(spark, f"{small}/events.parquet")))
    assert sessions.agg(F.sum("count")).first()[0] == events.count()


def test_events_that_are_too_late_do_not_count(spark, tmp_path):
    """Four files, one a batch: the second moves the watermark, which holds from the batch after the next one."""
    times = [["2024-01-01 10:00:00", "2024-01-01 10:30:00"], ["2024-01-02 10:00:00"], ["2024-01-02 10:01:00"], ["2024-01-01 10:59:00", "2024-01-02 09:30:00"]]
    folder = tmp_path / "events"
    for k, of in enumerate(times):
        rows = spark.createDataFrame([(t, "view") for t in of], "ts string, event_type string")
        rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        folder.mkdir(exist_ok=True)
        [part] = [p for p in (tmp_path / f"w{k}").iterdir() if p.suffix == ".parquet"]
        part.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = counters.to_table(counters.counts(stream, "1 hour", "event_type"), ["bucket", "event_type"])
    assert {str(r["bucket"]): r["count"] for r in got.collect()} == {"2024-01-01 10:00:00": 2, "2024-01-02 10:00:00": 2, "2024-01-02 09:00:00": 1}


def test_a_stream_of_nothing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "none"))
    assert counters.to_table(counters.counts(stream, "1 hour")).collect() == []


def test_spelling_uses_frequency_and_distance(spark):
    words = spark.createDataFrame([("ring", 5), ("rind", 1), ("widget", 2)], "word string, freq long")
    got = spell.corrections(spark.createDataFrame([("rinf",), ("qqqqqq",)], "word string"), spell.deletes(words), words)
    assert {r["word"]: (r["correction"], round(r["confidence"], 3)) for r in got.collect()} == {"rinf": ("ring", 0.667), "qqqqqq": ("qqqqqq", 0.5)}
    fixed = spell.closest_words(spark.createDataFrame([("widgte",), ("rin",)], "token string"), words)
    assert {r["token"]: r["fixed"] for r in fixed.collect()} == {"widgte": "widget", "rin": "rin"}


def test_equal_texts_get_equal_vectors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, t string")
    got = {r["id"]: r["vector"] for r in vectors.embed(df, F.col("t"), 8).collect()}
    assert got[1] == got[2] != got[3]


def test_upsert_replaces(spark):
    one = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<double>")
    two = spark.createDataFrame([("b", [3.0]), ("c", [4.0])], "id string, vector array<double>")
    assert {r["id"]: r["vector"] for r in vectors.upsert(one, two).collect()} == {"a": [1.0], "b": [3.0], "c": [4.0]}


def test_approximate_neighbours(spark):
    """Recall against all, and all where too few share a bucket."""
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(rng.normal(size=(600, 32)))], "id string, vector array<double>").cache()
    hit = 0
    for k in range(5):
        probe = rng.normal(size=32).tolist()
        exact, near = ({r["id"] for r in f(points, probe, 10).collect()} for f in (vectors.top_k, vectors.approximate_top_k))
        hit += len(exact & near)
    assert hit >= 45
    assert vectors.approximate_top_k(points, probe, 10, bucket=1e-9).count() == 10
