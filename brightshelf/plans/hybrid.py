"""Hybrid search: the spelling is corrected, then keyword and vector hits are fused and reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search, spell, vectors
from ..sources.catalog import DEMO, of_project
from ..sources.snapshots import Snapshots
from . import requests

#: Hits of each kind that are fused.
FUSED = 100


def hybrid_search(
    spark: SparkSession, q: str, words: DataFrame, index: search.Index, catalog: DataFrame, dim: int = 64, offset: int = 0, limit: int = 20, project_id: str = DEMO, stored: Snapshots | None = None
) -> DataFrame:
    """(query_id, id, score, position, corrected): a page of one query's results in one project; ``words`` is the speller's
    dictionary. With ``stored``, vectors of products are read there, and only those of new texts are made."""
    asked = requests.of_queries(spark, [q], FUSED, project_id)
    corrected = spell.check(asked.select("query_id", "q"), words).first()["corrected"]
    asked = requests.of_queries(spark, [corrected], FUSED, project_id)
    own = of_project(catalog, project_id)
    keyword = search.search(asked, index, own).select("query_id", "id", "position")
    texts = own.withColumn("search_text", F.lit(""))
    wanted = vectors.mock_vector(corrected, dim).tolist()
    if stored:
        points = vectors.embed_stored(texts, X.embedding_text(), stored, dim)[0].select("id", "vector", F.create_map().cast("map<string,string>").alias("payload"))
        near = vectors.top_k(points, wanted, FUSED)
    else:
        near = vectors.nearest_texts(texts, X.embedding_text(), wanted, FUSED, dim)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    near = near.withColumn("query_id", F.lit(0)).select("query_id", "id", place.alias("position"))
    return vectors.hybrid(asked, keyword, near, own, offset, limit).withColumn("corrected", F.lit(corrected))
