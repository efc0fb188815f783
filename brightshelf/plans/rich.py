"""The second search: placed postings, padded n-grams, many ranking factors, highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import index, ranking, search
from ..sources.catalog import with_discount

#: What a hit by n-grams keeps, and how similar its token must be.
KEPT, SIMILAR = 0.8, 0.5


def build(catalog: DataFrame) -> search.Index:
    posted = index.placed_postings(catalog)
    return search.Index(posted, index.ngram_index(posted, X.padded_ngrams))


def prepared(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, project_id, q) with their tokens, without synonyms."""
    n = X.normalize("q")
    return queries.select("query_id", "project_id", "q", n.alias("normalized"), X.tokenize_split(n).alias("tokens"))


def base_scores(processed: DataFrame, idx: search.Index) -> DataFrame:
    """(query_id, product_id, base): the sum of the tokens' scores; by n-grams where no token hits."""
    tokens = processed.select("query_id", "project_id", F.explode("tokens").alias("token"))
    direct = tokens.join(idx.postings, ["project_id", "token"]).groupBy("query_id", "project_id", "product_id").agg(F.bround(F.sum("score"), 9).alias("base"))
    none = processed.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    close = search.ngram_hits(none, idx, KEPT, SIMILAR, X.padded_ngrams).select("query_id", "project_id", "product_id", F.col("score").alias("base"))
    return direct.unionByName(close)


def rich_search(
    queries: DataFrame, idx: search.Index, catalog: DataFrame, popularity: DataFrame, filters: dict | None = None, sort: str = "relevance", offset: int = 0, limit: int = 20
) -> DataFrame:
    """(query_id, position, id, name, final, total, ...). ``popularity`` is (id, popularity)."""
    processed = prepared(queries)
    products = ranking.filtered(with_discount(catalog), filters).join(popularity, "id", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0.0)))
    hits = base_scores(processed, idx).withColumnRenamed("product_id", "id").join(products, ["project_id", "id"]).join(processed.select("query_id", "tokens"), "query_id")
    ordered = ranking.ranked(hits)
    ordered = ordered if sort == "relevance" else ranking.resorted(ordered, sort)
    totals = ordered.groupBy("query_id").agg(F.count("*").alias("total"))
    page = ordered.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).join(totals, "query_id")
    return page.select("query_id", "position", "id", "name", "tokens", F.bround("final", 6).alias("final"), "total", "price", "category", "brand", "in_stock")


def highlighted(page: DataFrame, tokens: list[str]) -> DataFrame:
    """A page of one query's results with its tokens marked in the names."""
    return page.withColumn("highlighted_name", X.highlight("name", tokens))


def suggested_products(queries: DataFrame, idx: search.Index, catalog: DataFrame, popularity: DataFrame, limit: int = 4) -> DataFrame:
    """What is shown beside the suggestions of a prefix: its first products."""
    return rich_search(queries, idx, catalog, popularity, limit=limit)
