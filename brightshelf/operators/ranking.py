"""The richer ranking: text, popularity and commerce in one score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT, POPULARITY, COMMERCIAL = 0.4, 0.2, 0.2
OUT_OF_STOCK = 0.3


def filtered(products: DataFrame, filters: dict | None) -> DataFrame:
    """price_min, price_max, in_stock, category (contained, whatever the case), brand (equal, whatever the case)."""
    f = filters or {}
    tests = [F.lit(True)]
    if f.get("price_min") is not None:
        tests.append(F.col("price") >= f["price_min"])
    if f.get("price_max") is not None:
        tests.append(F.col("price") <= f["price_max"])
    if f.get("in_stock"):
        tests.append(F.col("in_stock"))
    if f.get("category"):
        tests.append(F.contains(F.lower("category"), F.lit(f["category"].lower())))
    if f.get("brand"):
        tests.append(F.lower("brand") == f["brand"].lower())
    return products.where(reduce(Column.__and__, tests))


def position_score(name: Column, tokens: Column) -> Column:
    """How early in the name the first of the tokens stands: 1 at its start, 0 if none does."""
    places = F.filter(F.transform(tokens, lambda t: F.instr(F.lower(name), t)), lambda p: p > 0)
    return F.when(F.size(places) > 0, 1.0 - (F.array_min(places) - 1) / F.length(name)).otherwise(0.0)


def final_score(max_price: Column, max_popularity: Column) -> Column:
    """Of a row with base, name, tokens, price, popularity, discount_percent and in_stock."""
    name, tokens = F.col("name"), F.col("tokens")
    exact = F.when(F.contains(F.lower(name), F.lower(F.array_join(tokens, " "))), 1.0).otherwise(0.0)
    text = F.col("base") * 0.5 + position_score(name, tokens) * 0.3 + exact * 0.2
    commercial = F.coalesce(F.col("discount_percent") / 100, F.lit(0.0)) * 0.6 + (1 - F.col("price") / max_price) * 0.4
    score = text * TEXT + F.col("popularity") / max_popularity * POPULARITY + commercial * COMMERCIAL
    return score * F.when(F.col("in_stock"), 1.0).otherwise(OUT_OF_STOCK)


def ranked(hits: DataFrame) -> DataFrame:
    """``hits`` (query_id, tokens, base, id, name, price, ...) with final and position. Prices and popularity are measured
    against the highest among a query's hits, which an aggregation finds. Scores are ordered by 9 places."""
    high = lambda c: F.when(F.max(c) != 0, F.max(c)).otherwise(1.0)
    top = hits.groupBy("query_id").agg(high("price").alias("max_price"), high("popularity").alias("max_popularity"))
    rows = hits.join(top, "query_id").withColumn("final", final_score(F.col("max_price"), F.col("max_popularity")))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.bround("final", 9)), F.desc("base"), F.desc("id"))))


def resorted(hits: DataFrame, sort: str) -> DataFrame:
    """Orders by popularity or price instead; ties keep the position."""
    key = {"popular": F.desc("popularity"), "price_asc": F.asc("price"), "price_desc": F.desc("price")}[sort]
    return hits.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(key, "position")))


def top_counts(hits: DataFrame, field: str, limit: int = 10) -> DataFrame:
    """(value, count): the most frequent values of a field among hits, ties in the order of their first hit."""
    counts = hits.where(F.coalesce(field, F.lit("")) != "").groupBy(F.col(field).alias("value")).agg(F.count("*").alias("count"), F.min("position").alias("seen"))
    return counts.orderBy(F.desc("count"), "seen").limit(limit).drop("seen")
