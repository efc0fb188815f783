"""A shop's stored catalog and index: versions that are published whole, index segments that are merged when they are read."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import impact, index, search
from ..sources import catalog, feeds
from ..sources.snapshots import Snapshots

#: Segments of the postings after which a run merges them.
SEGMENTS = 8
#: Kinds of index: what scores a product's tokens, and what cuts tokens into n-grams.
KINDS: dict[str, tuple[Callable, Callable]] = {"plain": (index.postings, X.ngrams), "rich": (index.placed_postings, X.padded_ngrams)}


class Shop:
    """The tables ``catalog``, ``postings`` (in blocks of impact), ``heads``, ``ngrams``, ``suggest`` and ``gone`` under a folder.

    Each run writes one part of each table, a segment, and publishes them as one version. ``gone`` holds the products that
    a run changed or deleted, or a project alone (product_id null) that it replaced: rows of earlier segments that it names
    are dead. So a run over 1000 products writes some thousand rows, whatever the size of the index. Suggestions are counts
    that are added up, so a change writes what it takes away with a minus.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "plain"):
        self.spark, self.saved, self.kind = spark, Snapshots(spark, path), kind
        self.scored, self.cut = KINDS[kind]
        self._held: tuple[int, impact.Impacts] | None = None

    # What readers see.

    def _gone(self, version: dict) -> tuple[DataFrame | None, DataFrame | None, int]:
        """(replaced projects, products that are gone) with the newest version that says so, and the newest of all."""
        rows = self.saved.rows("gone", version)
        if rows is None:
            return None, None, 0
        dead = lambda some, *by: some.groupBy(*by).agg(F.max("at").alias("dead"))
        return dead(rows.where("product_id is null"), "project_id"), dead(rows.where("product_id is not null"), "project_id", "product_id"), max(p["at"] for p in version["tables"]["gone"])

    def _live(self, table: str, version: dict, product: str | None = None) -> DataFrame | None:
        """The rows of a table that no later segment has made dead; ``product`` is its column of product ids, if it has one."""
        projects, products, newest = self._gone(version)
        out = []
        for at, rows in self.saved.parts(table, version):
            if at < newest:
                later = lambda some, at=at: some.where(F.col("dead") > at).drop("dead")
                rows = rows.join(later(projects), "project_id", "left_anti")
                if product:
                    rows = rows.join(later(products).withColumnRenamed("product_id", product), ["project_id", product], "left_anti")
            out.append(rows)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out) if out else None

    def version(self, number: int | None = None) -> dict:
        return self.saved.version(number)

    def catalog(self, version: dict | None = None) -> DataFrame:
        found = self._live("catalog", version or self.version(), "id")
        return self.spark.createDataFrame([], catalog.SCHEMA) if found is None else found

    def impacts(self, version: dict | None = None) -> impact.Impacts:
        """The index in blocks. Its heads count dead rows too, at most one for each product that is gone."""
        v = version or self.version()
        if self._held and self._held[0] == v["number"]:
            return self._held[1]
        blocks, heads, ngrams = self._live("postings", v, "product_id"), self._live("heads", v), self._live("ngrams", v)
        if blocks is None:
            empty = self.spark.createDataFrame([], "project_id string, product_id string, token string, score double")
            posted = impact.blocks(empty)
            return impact.Impacts(posted, impact.heads(posted), index.ngram_index(empty))
        n = sum(p.get("rows", 0) for p in v["tables"]["gone"])
        several = len(v["tables"]["ngrams"]) > 1
        self._held = v["number"], impact.Impacts(blocks, heads, ngrams.distinct() if several else ngrams, n)
        return self._held[1]

    def index(self, version: dict | None = None) -> search.Index:
        return self.impacts(version).index()

    def suggestions(self, version: dict | None = None) -> DataFrame:
        rows = self._live("suggest", version or self.version())
        if rows is None:
            return self.spark.createDataFrame([], "project_id string, prefix string, freq long")
        return rows.groupBy("project_id", "prefix").agg(F.sum("freq").alias("freq")).where("freq > 0")

    # What writers do.

    def _segment(self, products: DataFrame | None, before: DataFrame | None = None) -> dict[str, list[str]]:
        """Writes the parts of some products; what the catalog had of them before is taken out of the suggestions."""
        out = {}
        write = lambda name, df, order, write=self.saved.write: out.setdefault(name, []).append(write(df, name, order))
        suggested = [index.suggest_index(products)] if products is not None else []
        if before is not None:
            suggested.append(index.suggest_index(before).withColumn("freq", -F.col("freq")))
        if suggested:
            write("suggest", reduce(DataFrame.unionByName, suggested), ["project_id", "prefix"])
        if products is not None:
            write("catalog", products, ["project_id", "id"])
            write("postings", impact.blocks(self.scored(self.saved.part(out['catalog'][0]))), impact.order(), self.saved.write_once)
            posted = self.saved.part(out['postings'][0])
            write("heads", impact.heads(posted), ["project_id", "token"])
            write("ngrams", index.ngram_index(posted, self.cut), ["project_id", "ngram"], self.saved.write_once)
        return out

    def _dead(self, ids: DataFrame) -> str:
        return self.saved.write(ids.select("project_id", F.col("id").alias("product_id")).distinct(), "gone", counted=True)

    def replace(self, products: DataFrame, project_id: str) -> int:
        """A project's catalog and index anew: nothing of it that was there before is left. Of equal ids the last counts."""
        base = self.version()
        parts = self._segment(catalog.latest(catalog.of_project(products, project_id)))
        whole = self.spark.createDataFrame([(project_id, None)], "project_id string, product_id string")
        return self.saved.publish(base, parts | {"gone": [self.saved.write(whole, "gone")]})

    def upsert(self, products: DataFrame, base: dict | None = None) -> int:
        """Products that are new or changed, of any projects; the rows of others are not written."""
        base = base or self.version()
        rows = catalog.latest(products)
        ids = rows.select("project_id", "id")
        old = self.catalog(base).join(ids, ["project_id", "id"], "left_semi")
        parts = self._segment(rows, old)
        return self._merged(self.saved.publish(base, parts | {"gone": [self._dead(self.saved.part(parts['catalog'][0]))]}))

    def delete(self, ids: DataFrame) -> int:
        """The products of some (project_id, id) go."""
        base = self.version()
        old = self.catalog(base).join(ids.select("project_id", "id").distinct(), ["project_id", "id"], "left_semi")
        return self.saved.publish(base, self._segment(None, old) | {"gone": [self._dead(ids)]})

    def clear(self, project_id: str) -> int:
        whole = self.spark.createDataFrame([(project_id, None)], "project_id string, product_id string")
        return self.saved.publish(self.version(), {"gone": [self.saved.write(whole, "gone")]})

    def _merged(self, number: int) -> int:
        return self.compact() if len(self.version(number)["tables"]["postings"]) > SEGMENTS else number

    def compact(self) -> int:
        """All segments become one, without what is dead; what readers see stays the same."""
        base = self.version()
        idx = self.impacts(base)
        parts = {"catalog": [self.saved.write(self.catalog(base), "catalog", ["project_id", "id"])], "suggest": [self.saved.write(self.suggestions(base), "suggest", ["project_id", "prefix"])]}
        parts["postings"] = [self.saved.write(idx.blocks, "postings", impact.order())]
        posted = self.saved.part(parts['postings'][0])
        parts["heads"] = [self.saved.write(impact.heads(posted), "heads", ["project_id", "token"])]
        parts["ngrams"] = [self.saved.write(index.ngram_index(posted, self.cut), "ngrams", ["project_id", "ngram"])]
        return self.saved.publish(base, parts, (*parts, "gone"))

    # Feed runs.

    def full(self, raw: DataFrame, project_id: str, url: str = "") -> DataFrame:
        """Validates mapped rows, replaces the project and returns the row of the log."""
        began = time.monotonic()
        good, bad = feeds.validated(raw)
        number = self.replace(feeds.transformed(good, project_id), project_id)
        n = catalog.of_project(self.catalog(self.version(number)), project_id).count()
        return feeds.run_row(self.spark, project_id, url, "done", n, bad.count(), updated=n, duration_ms=_since(began))

    def delta(self, rows: DataFrame, project_id: str, url: str = "") -> DataFrame:
        """Merges stock updates: products whose price, stock or quantity changed become a segment, with their scores computed
        anew, so that a search is that of an index that is built from the changed catalog. Returns the row of the log."""
        began = time.monotonic()
        base, changes = self.version(), feeds.delta(rows)
        before = catalog.of_project(self.catalog(base), project_id)
        touched = before.join(changes.select("id").distinct(), "id", "left_semi")
        merged = index.merge_delta(touched, changes, project_id).where("changed")
        # Written before it is counted and indexed, so that it is computed once.
        kept = self.saved.part(self.saved.write(merged.select(before.columns), "changes"))
        n = kept.count()
        if n:
            self.upsert(kept, base)
        return feeds.run_row(self.spark, project_id, url, "done", changes.count(), 0, updated=n, duration_ms=_since(began))

    def recover(self, backup: DataFrame, projects: DataFrame) -> DataFrame:
        """Products of ``projects`` (project_id) that the catalog has none of come back from the backup, and with them their index.
        Returns what was done for each project; as catalog and index change together, none is without its index."""
        base = self.version()
        there = self.catalog(base)
        plan = catalog.recovery_plan(projects, there, there, backup)
        lost = plan.where("step = 'restore'").select("project_id")
        done = self.saved.part(self.saved.write(plan, "plans"))
        if not done.where("step = 'restore'").isEmpty():
            self.upsert(catalog.from_backup(backup.join(lost, "project_id", "left_semi")), base)
        return done


def _since(began: float) -> int:
    return round((time.monotonic() - began) * 1000)


def tick(shop: Shop, files: DataFrame, projects: DataFrame, now, progress: str):
    """The scheduler's tick as a stream: ``files`` (project_id, path, kind, read_at) names feed files as they come.

    Of a batch's files those are read whose project's feed is due (``analytics.stale_feeds`` over ``projects`` and the
    shop's own log), the newest of each project. A batch's number goes into the log with its runs, so a batch that is run
    again after a failure finds its number there and changes nothing.
    """
    from ..operators.analytics import stale_feeds

    def load(batch: DataFrame, number: int) -> None:
        base = shop.version()
        log = shop.saved.rows("log", base)
        if log is not None and not log.where(F.col("batch") == number).isEmpty():
            return
        runs = log.select("project_id", "last_update", "ts") if log is not None else shop.spark.createDataFrame([], "project_id string, last_update string, ts int")
        due = stale_feeds(projects, runs, now).select("project_id")
        newest = batch.join(due, "project_id", "left_semi").groupBy("project_id").agg(F.max_by(F.struct("path", "kind"), F.struct("read_at", "path")).alias("f"))
        rows = []
        for r in newest.toLocalIterator():
            good, bad = feeds.validated(feeds.read(shop.spark, r["f"]["path"], r["f"]["kind"] or ""))
            rows.append((r["project_id"], feeds.transformed(good, r["project_id"]), bad.count()))
        tables: dict[str, list[str]] = {}
        logged = []
        for project, products, errors in rows:
            parts = shop._segment(catalog.latest(products))
            whole = shop.spark.createDataFrame([(project, None)], "project_id string, product_id string")
            for name, paths in (parts | {"gone": [shop.saved.write(whole, "gone")]}).items():
                tables.setdefault(name, []).extend(paths)
            n = shop.saved.part(parts["catalog"][0]).count()
            logged.append((project, number, n, errors, str(now), number))
        written = shop.spark.createDataFrame(logged or [("", number, 0, 0, "", number)], "project_id string, batch long, processed long, errors long, last_update string, ts int")
        shop.saved.publish(base, tables | {"log": [shop.saved.write(written, "log")]})

    return files.writeStream.option("checkpointLocation", progress).foreachBatch(load).trigger(availableNow=True).start()
