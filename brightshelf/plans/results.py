"""Pages of results that are kept for a while, and looked up before a batch is searched."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search
from ..sources.snapshots import Snapshots
from .shop import Shop

#: Seconds that a page is kept.
KEPT = 300


class Results:
    """Pages by the key of their request and the version of the shop that they were found in.

    ``keys`` (key, number, until) says which pages are there, so that a request without results is kept too; ``pages``
    (key, number, rows as search.search() gives them) holds them. A page of another version, or one that has expired, is
    not found; evict() drops it.
    """

    def __init__(self, saved: Snapshots, kept: float = KEPT, clock=time.time):
        self.saved, self.kept, self.clock = saved, kept, clock

    def _valid(self, number: int, version: dict) -> DataFrame | None:
        keys = self.saved.rows("keys", version)
        return None if keys is None else keys.where((F.col("number") == number) & (F.col("until") > self.clock())).select("key").distinct()

    def search(self, shop: Shop, queries: DataFrame, offset: int = 0, filters: dict | None = None, sort: str = "relevance") -> DataFrame:
        """What search.search() gives for a batch of up to search.BATCH queries. Those whose page is there are read; only the others
        are searched, as one batch, and their pages kept."""
        spark, number, base = shop.spark, shop.version()["number"], self.saved.version()
        shown = json.dumps(filters, sort_keys=True, ensure_ascii=False) if filters else ""
        asked = queries.select("query_id", "project_id", "q", "limit", F.concat("project_id", F.lit("|"), X.cache_key("q", F.col("limit"), offset, sort, shown)).alias("key"))
        rows = [r.asDict() for r in asked.take(search.BATCH + 1)]
        if len(rows) > search.BATCH:
            return search.search(queries, shop.index(), shop.catalog(), offset, filters, sort)
        literal = lambda some: search.literal_rows(spark, some, "query_id int, project_id string, q string, `limit` int, key string")
        valid = self._valid(number, base)
        there = {r["key"] for r in valid.join(literal(rows), "key", "left_semi").collect()} if valid is not None else set()
        missing = list({r["key"]: r for r in rows if r["key"] not in there}.values())
        if missing:
            found = search.search(literal(missing).drop("key"), shop.index(), shop.catalog(), offset, filters, sort)
            pages = found.join(literal(missing).select("query_id", "key"), "query_id").drop("query_id").withColumn("number", F.lit(number))
            keys = literal(missing).select("key", F.lit(number).alias("number"), F.lit(self.clock() + self.kept).alias("until"))
            base = self.saved.version(self.saved.publish(base, {"pages": [self.saved.write(pages, "pages")], "keys": [self.saved.write(keys, "keys")]}))
        kept = self.saved.rows("pages", base).where((F.col("number") == number) & F.col("key").isin(sorted({r["key"] for r in rows}))).drop("number")
        # Of a page that was found anew after it had expired, the newest counts.
        newest = kept.groupBy("key").agg(F.max("at").alias("at"))
        page = literal(rows).select("query_id", "key").join(kept.join(newest, ["key", "at"]), "key")
        return page.drop("key", "at")

    def evict(self, shop: Shop) -> int:
        """Drops the pages that are not found any more; returns how many keys stay."""
        base = self.saved.version()
        valid = self._valid(shop.version()["number"], base)
        if valid is None:
            return 0
        keys = self.saved.rows("keys", base).where((F.col("number") == shop.version()["number"]) & (F.col("until") > self.clock()))
        pages = self.saved.rows("pages", base).join(keys.select("key", "number", "at"), ["key", "number", "at"], "left_semi")
        kept = {"keys": self.saved.write(keys.drop("at"), "keys", counted=True), "pages": self.saved.write(pages.drop("at"), "pages")}
        after = self.saved.version(self.saved.publish(base, {k: [v] for k, v in kept.items()}, ("keys", "pages")))
        return after["tables"]["keys"][0]["rows"]
