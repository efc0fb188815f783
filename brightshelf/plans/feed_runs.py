"""Feed runs: from a file to the stored catalog, with a row for the log."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..operators import index
from ..sources import catalog, feeds


def _since(began: float) -> int:
    return round((time.monotonic() - began) * 1000)


def full(spark: SparkSession, raw: DataFrame, path: str, project_id: str, url: str = "") -> DataFrame:
    """Validates mapped rows, replaces the project's catalog and index under ``path``, and returns the row of the log."""
    began = time.monotonic()
    good, bad = feeds.validated(raw)
    products = feeds.transformed(good, project_id)
    catalog.write(catalog.latest(products), f"{path}/catalog")
    stored = catalog.read(spark, f"{path}/catalog", project_id)
    index.write_index(stored, f"{path}/index")
    n = stored.count()
    return feeds.run_row(spark, project_id, url, "done", n, bad.count(), updated=n, duration_ms=_since(began))


def delta(spark: SparkSession, rows: DataFrame, path: str, project_id: str, url: str = "") -> DataFrame:
    """Merges stock updates into the project's catalog; it is written anew beside the old one, which is then replaced."""
    began = time.monotonic()
    changes = feeds.delta(rows)
    before = catalog.read(spark, f"{path}/catalog", project_id)
    merged = index.merge_delta(before, changes, project_id)
    changed = merged.where("changed").count()
    kept = [c for c in before.columns if c != "project_id"]
    merged.select("project_id", *kept).write.mode("overwrite").parquet(f"{path}/next")
    catalog.write(spark.read.parquet(f"{path}/next"), f"{path}/catalog")
    return feeds.run_row(spark, project_id, url, "done", changes.count(), 0, updated=changed, duration_ms=_since(began))


def refresh_plan(projects: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Which feeds a scheduler's tick is to load."""
    from ..operators.analytics import stale_feeds

    return stale_feeds(projects, runs, now)


def recover(spark: SparkSession, path: str, projects: DataFrame) -> DataFrame:
    """Runs what recovery_plan() names for each of ``projects`` (project_id) under ``path``: products come back from the backup,
    and an index is built where there is none. Returns the plan that was carried out."""
    saved = f"{path}/backup"
    none = lambda: spark.createDataFrame([], "project_id string")
    there = lambda p: _read(spark, p) or none()
    plan = catalog.recovery_plan(projects, there(f"{path}/catalog"), there(f"{path}/index/postings"), there(saved))
    # The decisions are written before what they were made from changes; products follow them by joins.
    plan.write.mode("overwrite").parquet(f"{path}/recovery")
    plan = spark.read.parquet(f"{path}/recovery")
    lost, missing = plan.where("step = 'restore'"), plan.where("step in ('restore', 'rebuild')")
    of = lambda df, projects: df.join(projects.select("project_id"), "project_id", "left_semi")
    if not lost.isEmpty():
        catalog.write(catalog.from_backup(of(spark.read.parquet(saved), lost)), f"{path}/catalog")
    if not missing.isEmpty():
        index.write_index(of(spark.read.parquet(f"{path}/catalog"), missing), f"{path}/index")
    return plan


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None
