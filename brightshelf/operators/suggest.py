"""Autocomplete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.catalog import DEMO, of_project
from .facets import category_counts


def suggest(index: DataFrame, prefix: str, limit: int = 10, project_id: str = DEMO) -> DataFrame:
    """(prefix, freq): a project's suggestions that start with the normalized prefix, the most frequent first, ties from z to a."""
    normalized = index.sparkSession.range(1).select(X.normalize(F.lit(prefix)).alias("n")).first()[0]
    own = of_project(index, project_id)
    rows = own.where(F.startswith("prefix", F.lit(normalized))) if normalized else own
    return rows.select("prefix", "freq").orderBy(F.desc("freq"), F.desc("prefix")).limit(limit)


def first_text(index: DataFrame, prefix: str, project_id: str = DEMO) -> str:
    """What products are searched by: the first suggestion, or else the prefix itself."""
    found = suggest(index, prefix, 1, project_id).first()
    return found[0] if found else prefix


def suggest_highlighted(index: DataFrame, prefix: str, limit: int = 5, texts: int = 3, project_id: str = DEMO) -> DataFrame:
    """At most three suggestions, each with itself as its highlight."""
    return suggest(index, prefix, min(texts, max(1, min(limit, 20))), project_id).withColumn("highlight", F.col("prefix"))


def suggest_bucketed(index: DataFrame, prefix: str, limit: int = 10, project_id: str = DEMO) -> DataFrame:
    """A project's suggestions of the prefix's three-character bucket: the best 2 * limit + 1 of it are looked through."""
    low = prefix.lower().strip()
    if len(low) < 2:
        return index.where(F.lit(False)).select("prefix", "freq", F.lit("").alias("highlight"))
    bucket = of_project(index, project_id).where(F.col("prefix3") == low[:3]).orderBy(F.desc("freq"), F.desc("prefix")).limit(2 * limit + 1)
    rows = bucket.where(F.startswith("prefix", F.lit(low))).orderBy(F.desc("freq"), F.desc("prefix")).limit(limit)
    return rows.select("prefix", "freq", X.highlight_prefix("prefix", low).alias("highlight"))


def suggest_categories(catalog: DataFrame, prefix: str, limit: int = 3, project_id: str = DEMO) -> DataFrame:
    """(category, count, slug): categories that contain the prefix."""
    rows = category_counts(catalog, project_id).where(F.contains(F.lower("category"), F.lit(prefix.lower())))
    return rows.orderBy(F.desc("count"), "category").limit(limit).select("category", "count", X.category_slug("category").alias("slug"))
