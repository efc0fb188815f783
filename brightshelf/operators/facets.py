"""Facets of search results: categories, price bounds, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import DEMO, of_project
from .search import loaded, merit, non_price_filter, price, price_filter

#: A parameter is shown if this share of the results has it and its values are no more than this share distinct; how many
#: parameters and values are shown.
COVERAGE, DISTINCT, GROUPS, VALUES = 0.05, 0.8, 8, 20


def products(hits: DataFrame, catalog: DataFrame, filters: dict | None = None) -> DataFrame:
    """Hits with their products and ``merit``, of those that pass all filters but the price. The earlier of two hits is that of
    the greater merit; so the first of many is an aggregate, and hits need not be sorted."""
    return loaded(hits, catalog).withColumn("merit", F.struct(*merit())).where(non_price_filter(filters))


def categories(rows: DataFrame, filters: dict | None = None) -> DataFrame:
    """(query_id, value, count, position): by count, ties in the order of their first product."""
    counts = rows.where(price_filter(filters) & (F.coalesce("category", F.lit("")) != "")).groupBy("query_id", F.col("category").alias("value")).agg(F.count("*").alias("count"), F.max("merit").alias("seen"))
    return counts.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("count"), F.desc("seen")))).drop("seen")


def price_bounds(rows: DataFrame) -> DataFrame:
    """(query_id, min, max) whatever the price filter."""
    return rows.groupBy("query_id").agg(F.min(price()).alias("min"), F.max(price()).alias("max"))


def params(rows: DataFrame, filters: dict | None = None, fields: list[str] | None = None) -> DataFrame:
    """(query_id, key, key_position, value, count, value_position).

    Without ``fields`` the keys are chosen by coverage and distinct values, the best covered first, ties in the order of
    their first product; with them, they are those keys in that order.
    """
    passing = rows.where(price_filter(filters))
    pairs = passing.select("query_id", "merit", F.posexplode(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>")))).alias("at", "e"))
    pairs = pairs.select("query_id", "merit", (-F.col("at")).alias("at"), F.col("e.key").alias("key"), F.col("e.value").alias("value")).where(F.coalesce("value", F.lit("")) != "")
    if fields is not None:
        pairs = pairs.where(F.col("key").isin(fields)) if fields else pairs.where(F.lit(False))
    counts = pairs.groupBy("query_id", "key", "value").agg(F.count("*").alias("count"), F.max(F.struct("merit", "at")).alias("seen"))
    keys = counts.groupBy("query_id", "key").agg(F.sum("count").alias("having"), F.count("*").alias("distinct"), F.max("seen").alias("seen"))
    if fields is not None:
        place = F.create_map(*(x for k, f in enumerate(fields) for x in (F.lit(f), F.lit(k + 1)))) if fields else F.create_map().cast("map<string,int>")
        keys = keys.withColumn("key_position", F.try_element_at(place, F.col("key")))
    else:
        totals = passing.groupBy("query_id").agg(F.count("*").alias("total"))
        keys = keys.join(totals, "query_id").where((F.col("having") / F.col("total") >= COVERAGE) & (F.col("distinct") / F.col("having") <= DISTINCT))
        keys = keys.withColumn("key_position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("having") / F.col("total")), F.desc("seen")))).where(F.col("key_position") <= GROUPS)
    place = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("count"), "value"))
    out = counts.drop("seen").join(keys.select("query_id", "key", "key_position"), ["query_id", "key"]).withColumn("value_position", place)
    return out.where(F.col("value_position") <= VALUES).select("query_id", "key", "key_position", "value", "count", "value_position")


def together(rows: DataFrame, filters: dict | None = None, fields: list[str] | None = None) -> DataFrame:
    """All facets of ``rows`` by one pass: (query_id, facet, key, key_position, value, count, position, min, max).

    facet is ``category``, ``param`` (with its key) or ``price`` (with min and max); values, positions and limits are those of
    categories(), params() and price_bounds(). Each product is one row for each of its facets, and these are aggregated
    once; all that follows are windows over the values of one query.
    """
    inside = price_filter(filters)
    entry = lambda facet, key, value, at: F.struct(F.lit(facet).alias("facet"), key.alias("key"), value.alias("value"), at.cast("int").alias("at"))
    none = F.lit(None).cast("string")
    pairs = F.transform(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>"))), lambda e, k: entry("param", e["key"], e["value"], -k))
    pairs = F.filter(pairs, lambda e: (F.coalesce(e["value"], F.lit("")) != "") & (e["key"].isin(fields) if fields else F.lit(fields is None)))
    named = F.filter(F.array(entry("category", none, F.col("category"), F.lit(0))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    passing = F.concat(F.array(entry("total", none, none, F.lit(0))), named, pairs)
    each = F.concat(F.array(entry("price", none, none, F.lit(0))), F.when(inside, passing).otherwise(F.slice(passing, 1, 0)))
    flat = rows.select("query_id", "merit", price().alias("price"), F.explode(each).alias("f")).select("query_id", "merit", "price", "f.*")
    of = ["query_id", "facet", "key"]
    counts = flat.groupBy(*of, "value").agg(F.count("*").alias("count"), F.max(F.struct("merit", "at")).alias("seen"), F.min("price").alias("min"), F.max("price").alias("max"))
    whole = Window.partitionBy(*of)
    param, total = F.col("facet") == "param", F.max(F.when(F.col("facet") == "total", F.col("count"))).over(Window.partitionBy("query_id"))
    known = counts.withColumns({"having": F.sum("count").over(whole), "distinct": F.count("*").over(whole), "first": F.max("seen").over(whole), "total": total})
    if fields is None:
        shown = (F.col("having") / F.col("total") >= COVERAGE) & (F.col("distinct") / F.col("having") <= DISTINCT)
        known = known.where(~param | shown)
        place = F.when(param, F.dense_rank().over(Window.partitionBy("query_id", "facet").orderBy(F.desc(F.when(param, F.col("having") / F.col("total"))), F.desc(F.when(param, F.col("first"))))))
        known = known.withColumn("key_position", place).where(~param | (F.col("key_position") <= GROUPS))
    else:
        named = F.create_map(*(x for k, f in enumerate(fields) for x in (F.lit(f), F.lit(k + 1)))) if fields else F.create_map().cast("map<string,int>")
        known = known.withColumn("key_position", F.when(param, F.try_element_at(named, F.col("key"))))
    position = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("count"), F.desc(F.when(~param, F.col("seen"))), F.when(param, F.col("value"))))
    out = known.where(F.col("facet") != "total").withColumn("position", position).where(~param | (F.col("position") <= VALUES))
    bounds = [F.when(F.col("facet") == "price", F.col(c)).alias(c) for c in ("min", "max")]
    return out.select("query_id", "facet", "key", "key_position", "value", "count", "position", *bounds)


def category_counts(catalog: DataFrame, project_id: str = DEMO) -> DataFrame:
    """(category, count, total_products): the categories of a project by their products, ties by name."""
    catalog = of_project(catalog, project_id)
    counts = catalog.where(F.coalesce("category", F.lit("")) != "").groupBy("category").agg(F.count("*").alias("count"))
    return counts.join(catalog.agg(F.count("*").alias("total_products"))).orderBy(F.desc("count"), "category")


def field_values(catalog: DataFrame, field: str, limit: int = 50, project_id: str = DEMO) -> DataFrame:
    """(value, count): a project's values of a column or of ``params.<key>``, null and empty ones left out."""
    catalog = of_project(catalog, project_id)
    value = F.try_element_at("params", F.lit(field.removeprefix("params."))) if field.startswith("params.") else F.col(field).cast("string")
    counts = catalog.select(value.alias("value")).where(F.coalesce("value", F.lit("")) != "").groupBy("value").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(limit)


#: Columns that are no fields to choose from.
SERVICE = ("id", "name", "description", "url", "image", "price", "old_price", "in_stock", "project_id")


def fields(catalog: DataFrame, sample: int = 20, project_id: str = DEMO) -> DataFrame:
    """(field): what a project offers to filter by, from its first products by id: ``params.<key>``, brand, category and
    other columns that are not service ones."""
    rows = of_project(catalog, project_id).orderBy("id").limit(sample)
    keys = rows.select(F.explode(F.map_keys("params")).alias("k")).select(F.concat(F.lit("params."), "k").alias("field"))
    plain = [c for c in catalog.columns if c not in SERVICE and c != "params"] + ["brand", "category"]
    listed = catalog.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(plain)], "field string")
    return keys.union(listed).distinct().orderBy("field")


def price_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, min, max, count): four half-open ranges of one width over the prices above 0, so the highest price is in none."""
    prices = rows.where(F.col("price") > 0).select("price")
    bounds = prices.agg(F.min("price").alias("low"), F.max("price").alias("high"))
    step = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / 4).otherwise(1.0)
    ranges = bounds.where("low is not null").withColumn("step", step).select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bucket"), "low", "step")
    ranges = ranges.select("bucket", (F.col("low") + F.col("step") * F.col("bucket")).alias("a"), (F.col("low") + F.col("step") * (F.col("bucket") + 1)).alias("b"))
    # Both sides carry the bucket, so this is an equi-join and not a comparison of all prices with all ranges.
    placed = prices.join(F.broadcast(bounds.withColumn("step", step))).select("price", F.explode(F.array(*(F.floor((F.col("price") - F.col("low")) / F.col("step")).cast("int") + k for k in (-1, 0, 1)))).alias("bucket"))
    counts = placed.join(F.broadcast(ranges), "bucket").where((F.col("price") >= F.col("a")) & (F.col("price") < F.col("b"))).groupBy("bucket").agg(F.count("*").alias("n"))
    return ranges.join(counts, "bucket", "left").select("bucket", F.bround("a", 0).alias("min"), F.bround("b", 0).alias("max"), F.coalesce("n", F.lit(0)).alias("count"))
