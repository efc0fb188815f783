"""Requests as they come from outside, composed of the operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facets, related, search, suggest
from ..sources.catalog import DEMO


QUERY = "query_id int, project_id string, q string, `limit` int"


def of_queries(spark: SparkSession, texts: list[str], limit: int | list[int] = 20, project_id: str = DEMO) -> DataFrame:
    """(query_id, project_id, q, limit) of literal queries; one limit for all, or one for each."""
    limits = limit if isinstance(limit, list) else [limit] * len(texts)
    rows = [{"query_id": k, "project_id": project_id, "q": q, "limit": n} for k, (q, n) in enumerate(zip(texts, limits, strict=True))]
    return search.literal_rows(spark, rows, QUERY)


def search_request(spark: SparkSession, index: search.Index, catalog: DataFrame, request: dict, synonyms: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of an answer: items, related, and facets if they are asked for.

    ``request``: q, limit, filters (a dict or JSON text), min_price, max_price, in_stock, category, facets, facet_fields,
    sort, related_fields, related_limit.
    """
    structured = request.get("filters")
    structured = json.loads(structured) if isinstance(structured, str) else structured
    filters = search.overlaid(structured, **{k: request.get(k) for k in ("min_price", "max_price", "in_stock", "category")})
    project = request.get("project_id", DEMO)
    queries = of_queries(spark, [request["q"]], search.request_limit(request.get("limit")), project)
    wants = bool(request.get("facets"))
    out = {"items": search.search(queries, index, catalog, request.get("offset", 0), filters, request.get("sort", "relevance"), wants, synonyms)}
    if fields := request.get("related_fields"):
        out["related"] = related.related_groups(out["items"], catalog, search.as_list(fields), request.get("related_limit", 4), project)
    if wants:
        rows = facets.products(search.candidates(queries, index, synonyms), catalog, filters)
        out |= {"categories": facets.categories(rows, filters), "price": facets.price_bounds(rows), "params": facets.params(rows, filters, request.get("facet_fields"))}
    return out


def suggest_request(spark: SparkSession, suggestions: DataFrame, index: search.Index, catalog: DataFrame, q: str, limit: int = 5, project_id: str = DEMO) -> dict[str, DataFrame]:
    """Suggested texts, and the products of the first of them."""
    queries = of_queries(spark, [suggest.first_text(suggestions, q, project_id)], 8, project_id)
    return {"texts": suggest.suggest_highlighted(suggestions, q, limit, project_id=project_id), "products": search.search(queries, index, catalog)}


def overview(catalog: DataFrame) -> DataFrame:
    """(project_id, products, in_stock, categories)"""
    return catalog.groupBy("project_id").agg(F.count("*").alias("products"), F.count_if(F.col("in_stock")).alias("in_stock"), F.countDistinct("category").alias("categories"))
