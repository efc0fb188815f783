"""Nearest vectors of many queries at once, over a stored index of cells around centroids."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import norm

#: Vectors that centroids are fitted to at most, cells at most, and queries that go to the tasks at a time.
SAMPLE, CELLS, QUERIES = 100_000, 4096, 10_000
#: Queries that meet a batch's vectors at a time, rows that a task holds before it keeps the best of them alone, and what
#: sums may differ by from the order of their addition.
ASKED, HELD, SLACK = 256, 1_000_000, 1e-9
#: The share of the cells that is looked at for a query.
PROBED = 0.25


def _usable(collection: DataFrame) -> DataFrame:
    """Vectors that have a direction."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return collection.where(F.coalesce(finite, F.lit(False)) & (norm(F.col("vector")) > 0))


def fit(collection: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centroids of the directions of ``collection`` (id, vector), by k-means on a sample of bounded size.

    As many as the square root of the number of vectors, unless ``cells`` says. The centroids are a constant of the index;
    they are the only thing that comes to the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _usable(collection)
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    k = max(1, min(cells or round(n**0.5), CELLS, n))
    length = norm(F.col("vector"))
    taken = rows.sample(min(1.0, sample / n), seed) if n > sample else rows
    units = taken.select(array_to_vector(F.transform("vector", lambda x: x.cast("double") / length)).alias("features"))
    # Each round is work on every core, however few files the vectors lie in.
    units = units.repartition(collection.sparkSession.sparkContext.defaultParallelism)
    return np.array(KMeans(k=k, seed=seed, maxIter=10).fit(units).clusterCenters())


def _ranked(centroids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n nearest centroids of each row's direction, the nearest first."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    far = (centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)
    return far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]


def _nearest(centroids: np.ndarray, vector: str):
    """The number of the nearest centroid, as a column."""

    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series(_ranked(centroids, np.stack(vectors.to_list()).astype(float), 1)[:, 0] if len(vectors) else [], dtype="int32")

    return F.pandas_udf(run, "int")(F.col(vector).cast("array<double>"))


def write(collection: DataFrame, path: str, centroids: np.ndarray) -> None:
    """The vectors under ``path``, a folder for each cell, and the centroids beside them. Vectors without a direction are in none."""
    rows = _usable(collection)
    placed = rows.withColumn("cell", _nearest(centroids, "vector") if len(centroids) else F.lit(0))
    # A cell's vectors come together before they are written, so that the files are as many as the cells and no more.
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark = collection.sparkSession
    spark.createDataFrame([(json.dumps(centroids.tolist()),)], "centroids string").write.mode("overwrite").parquet(f"{path}/centroids")


def centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array(json.loads(spark.read.parquet(f"{path}/centroids").first()[0]))


def _first(found: pa.Table, k: int) -> pa.Table:
    """Of rows (query, score, id) the k best of each query."""
    t = found.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
    q = t["query"].to_numpy()
    return t.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def _best(asked: np.ndarray, cells: list[np.ndarray], k: int, batches) -> Iterator[pa.RecordBatch]:
    """(query, score, id): of the rows (cell, id, vector) of a task the k best of each query, a row of ``asked``; ``cells`` are those of
    each. Products of matrices say what can be among them, sums in the order of ``vectors.cosine`` what is."""
    of_cell: dict[int, np.ndarray] = {}
    number = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    flat = np.concatenate(cells)
    order = np.argsort(flat, kind="stable")
    flat, number = flat[order], number[order]
    for c in np.unique(flat):
        of_cell[int(c)] = number[np.searchsorted(flat, c) : np.searchsorted(flat, c, "right")]
    total = lambda products: np.cumsum(products, axis=1)[:, -1]
    length = np.sqrt(total(asked * asked))
    unit = asked / length[:, None]
    bar = np.full(len(asked), -np.inf)
    held: list[pa.Table] = []

    def kept() -> None:
        t = _first(pa.concat_tables(held).combine_chunks(), k)
        held[:] = [t]
        q, score = t["query"].to_numpy(), t["score"].to_numpy()
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
        bar[q[last]] = score[last]

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, ids = batch.column("cell").to_numpy(), batch.column("id")
        vector = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        own = np.sqrt(total(vector * vector))
        for c in np.unique(cell):
            rows, queries = np.flatnonzero(cell == c), of_cell.get(int(c), ())
            for a in range(0, len(queries), ASKED):
                some = queries[a : a + ASKED]
                near = unit[some] @ (vector[rows] / own[rows, None]).T
                least = bar[some]
                if len(rows) > k:
                    least = np.maximum(least, np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k])
                i, j = np.nonzero(near >= least[:, None] - SLACK)
                q, r = some[i], rows[j]
                score = total(vector[r] * asked[q]) / (own[r] * length[q])
                held.append(pa.table({"query": pa.array(q, pa.int32()), "score": score, "id": ids.take(pa.array(r))}))
                if sum(t.num_rows for t in held) > HELD:
                    kept()
    if held:
        kept()
        yield from held[0].to_batches()


def _named(numbers: np.ndarray, batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(numbers[batch.column("query").to_numpy()]), batch.column("score"), batch.column("id")], ["query_id", "score", "id"])


def search(spark: SparkSession, path: str, queries: list[tuple[int, list[float]]], k: int = 10, probed: float = PROBED) -> DataFrame:
    """(query_id, position, id, score): for each query (query_id, vector) the k best by cosine, ties by id.

    A query's nearest cells are known before anything is read, so no other folders are. A task meets the vectors of the
    cells that it reads with the queries that look there, and passes on no more than k rows of a query. Where a query's
    cells hold fewer than k vectors, more are looked at, if need be all. Queries without a direction have no rows.
    """
    found = centroids(spark, path)
    rows = spark.read.parquet(f"{path}/vectors") if len(found) else None
    if rows is None:
        return spark.createDataFrame([], "query_id int, position int, id string, score double")
    able = [(n, np.asarray(v, dtype=float)) for n, v in queries if v is not None and len(v) and np.isfinite(np.asarray(v, dtype=float)).all() and np.any(v)]
    now, later = able[:QUERIES], able[QUERIES:]
    of = rows.schema["id"].dataType.simpleString()
    if not now:
        return spark.createDataFrame([], f"query_id int, position int, id {of}, score double")
    probes = max(1, round(probed * len(found)))
    sizes = np.zeros(len(found), dtype=np.int64)
    for r in rows.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    asked, numbers = np.array([v for _, v in now]), np.array([n for n, _ in now], dtype=np.int32)
    wanted = []
    for a in range(0, len(asked), ASKED):
        ranked = _ranked(found, asked[a : a + ASKED], len(found)).astype(np.int32)
        # Enough cells for k vectors, all of them if need be.
        for of_query, there in zip(ranked, np.cumsum(sizes[ranked], axis=1), strict=True):
            m = probes
            while m < len(found) and there[m - 1] < k:
                m = min(2 * m, len(found))
            wanted.append(of_query[:m].copy())
    near = rows.where(F.col("cell").isin(np.unique(np.concatenate(wanted)).tolist())).select(F.col("cell").cast("int").alias("cell"), "id", "vector")
    best = near.mapInArrow(lambda batches: _named(numbers, _best(asked, wanted, k, batches)), f"query_id int, score double, id {of}")
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = best.withColumn("position", position).where(F.col("position") <= k).select("query_id", "position", "id", "score")
    return best.unionByName(search(spark, path, later, k, probed)) if later else best
