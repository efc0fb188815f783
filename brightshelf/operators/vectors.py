"""Vector collections, exact and approximate search, rank fusion, reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.snapshots import Snapshots

#: The constant of reciprocal rank fusion, and how many of the fused results are reranked.
RRF_K, RERANKED = 60, 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def matches(filters: dict | None, payload: str = "payload") -> Column:
    """``{"must": [{"key": k, "match": {"value": v}} | {"key": k, "range": {"gte": a, "lte": b}}]}`` over a map of strings."""
    tests = [F.lit(True)]
    for f in (filters or {}).get("must", ()):
        value = F.try_element_at(payload, F.lit(f["key"]))
        if "match" in f:
            v = f["match"]["value"]
            tests.append(F.coalesce(value == (str(v).lower() if isinstance(v, bool) else str(v)), F.lit(False)))
        for bound, test in (("gte", lambda a, b: a >= b), ("lte", lambda a, b: a <= b)):
            if (limit := f.get("range", {}).get(bound)) is not None:
                tests.append(F.coalesce(test(value.try_cast("double"), F.lit(float(limit))), F.lit(False)))
    return reduce(Column.__and__, tests)


def vector_filter(price_min=None, price_max=None, in_stock=None, category=None) -> dict | None:
    """The filter of a request in the form of matches()."""
    must = [{"key": "in_stock", "match": {"value": True}}] * bool(in_stock) + [{"key": "category", "match": {"value": category}}] * bool(category)
    bounds = {k: v for k, v in (("gte", price_min), ("lte", price_max)) if v is not None}
    must += [{"key": "price", "range": bounds}] * bool(bounds)
    return {"must": must} if must else None


def top_k(collection: DataFrame, vector: list[float], k: int = 10, filters: dict | None = None, metric: str = "cosine") -> DataFrame:
    """(id, score): the k best of a collection (id, vector, payload), ties by id. Only k rows of each task are gathered."""
    query = F.array(*(F.lit(float(x)) for x in vector))
    v = F.col("vector")
    score = {"cosine": cosine(v, query), "dot": dot(v, query), "euclidean": -norm(F.zip_with(v, query, lambda x, y: x - y))}[metric]
    rows = collection.where(matches(filters)) if filters else collection
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def approximate_top_k(collection: DataFrame, vector: list[float], k: int = 10, bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """The same by random projections: (id, distance) of unit vectors. A vector is looked at if it shares a bucket with the query
    in any of the tables; where fewer than k do, all are. Of 500 vectors without clusters the ten nearest were all found."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    n = norm(F.col("vector"))
    rows = collection.select("id", array_to_vector(F.transform("vector", lambda x: x / n)).alias("features"))
    q = np.asarray(vector, dtype=float)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=1).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense(q / np.linalg.norm(q)), k, distCol="distance").select("id", "distance")
    if found.count() == k:
        return found
    return top_k(collection, vector, k).select("id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("distance"))


def upsert(collection: DataFrame, points: DataFrame) -> DataFrame:
    return collection.join(points.select("id").distinct(), "id", "left_anti").unionByName(points)


def delete(collection: DataFrame, ids: DataFrame) -> DataFrame:
    return collection.join(ids.select("id").distinct(), "id", "left_anti")


def mock_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector of normal draws that the text's hash seeds."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")
    v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
    return v / np.linalg.norm(v)


def embed(df: DataFrame, text: Column, dim: int = 64, out: str = "vector", of: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """Adds the vectors of a text column, or what ``of`` makes of them. Equal texts, by their hash, are embedded once."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([mock_vector(t or "", dim) for t in texts])

    keyed = df.withColumns({"_text": text, "_key": F.md5(F.coalesce(text, F.lit("")))})
    # Dealt to all cores: a text is few bytes but much work, and small partitions are merged by their bytes.
    texts = keyed.groupBy("_key").agg(F.any_value("_text").alias("_text")).repartition(df.sparkSession.sparkContext.defaultParallelism, "_key")
    distinct = texts.select("_key", F.pandas_udf(run, "array<float>")("_text").alias("_vector")).select("_key", of(F.col("_vector")).alias(out))
    return keyed.join(distinct, "_key").drop("_key", "_text")


def nearest_texts(df: DataFrame, text: Column, vector: list[float], k: int, dim: int = 64) -> DataFrame:
    """(id, score): top_k() of the vectors of a text column by cosine. Products of equal texts are scored once."""
    query = F.array(*(F.lit(float(x)) for x in vector))
    return embed(df, text, dim, "score", lambda v: cosine(v, query)).select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def embed_stored(df: DataFrame, text: Column, store: Snapshots, dim: int = 64, out: str = "vector", drop: bool = False) -> tuple[DataFrame, int]:
    """embed(), with the vectors of texts kept under ``store`` by the texts' hash: (rows with vectors, texts that were embedded).

    Only texts whose hash is not there yet are embedded, and become a part of its table ``vectors``. With ``drop``, entries
    of texts that ``df`` no longer has go.
    """
    keyed = df.withColumns({"_text": text, "_key": F.sha2(F.concat(F.lit(f"{dim}:"), F.coalesce(text, F.lit(""))), 256)})
    base = store.version()
    known = store.rows("vectors", base)
    distinct = keyed.groupBy("_key").agg(F.any_value("_text").alias("_text"))
    missing = distinct if known is None else distinct.join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
    named = missing.select(F.col("_key").alias("key"), F.col("_text").alias("said"))
    part = store.write(embed(named, F.col("said"), dim).select("key", "vector"), "vectors")
    n = store.part(part).count()
    if drop and known is not None:
        kept = known.drop("at").join(distinct.select(F.col("_key").alias("key")), "key", "left_semi")
        base = store.version(store.publish(base, {"vectors": [store.write(kept, "vectors"), part]}, ("vectors",)))
    elif n or known is None:
        base = store.version(store.publish(base, {"vectors": [part]}))
    every = store.rows("vectors", base).select(F.col("key").alias("_key"), F.col("vector").alias(out))
    return keyed.join(every, "_key").drop("_key", "_text"), n


def create_collection(store: Snapshots, name: str) -> bool:
    """An empty collection of points, unless there is one of that name; whether it was made."""
    base = store.version()
    if name in base["tables"]:
        return False
    empty = store.spark.createDataFrame([], "id string, vector array<float>, payload map<string,string>")
    store.publish(base, {name: [store.write(empty, name)]})
    return True


def drop_collection(store: Snapshots, name: str) -> bool:
    """Whether there was one; its files go with the next vacuum()."""
    base = store.version()
    if not base["tables"].get(name):
        return False
    store.publish(base | {"tables": {k: v for k, v in base["tables"].items() if k != name}}, {})
    return True


def fuse(keyword: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf, position): reciprocal rank fusion of two ranked lists (query_id, id, position)."""
    one = lambda df, name: df.select("query_id", "id", (1.0 / (k + F.col("position"))).alias(name))
    both = one(keyword, "a").join(one(vector, "b"), ["query_id", "id"], "full_outer")
    scored = both.select("query_id", "id", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("rrf"), F.col("a").isNull().alias("late"))
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "late", "id"))).drop("late")


def rerank(fused: DataFrame, queries: DataFrame, texts: DataFrame, top: int = RERANKED) -> DataFrame:
    """(query_id, id, score, position): the first 20 by the share of the query's words that their text has, plus 1 / position."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"(?U)\s+")), lambda w: w != "")
    rows = fused.where(F.col("position") <= top).join(queries.select("query_id", words("q").alias("qw")), "query_id").join(texts.select("id", words("text").alias("tw")), "id")
    overlap = F.size(F.array_intersect("qw", "tw")) / F.greatest(F.size("qw"), F.lit(1))
    scored = rows.select("query_id", "id", F.col("position").alias("before"), (overlap + 1.0 / F.col("position")).alias("score"))
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "before"))).drop("before")


def hybrid(queries: DataFrame, keyword: DataFrame, vector: DataFrame, catalog: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """Keyword and vector hits fused, reranked and cut to a page."""
    fused = fuse(keyword.where("position <= 100"), vector.where("position <= 100"))
    texts = catalog.select("id", X.rerank_text().alias("text"))
    out = rerank(fused, queries, texts)
    return out.where((F.col("position") > offset) & (F.col("position") <= offset + limit))
