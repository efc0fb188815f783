"""Index building: weighted postings, n-grams, suggestions; their upkeep and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.catalog import DEMO, latest

#: What an occurrence of a token adds to its score, by field.
NAME, DESCRIPTION, BRAND, CATEGORY, VENDOR_CODE, PARAM = 3.0, 1.0, 2.0, 1.5, 3.0, 2.0
#: Products of a task that makes postings.
PRODUCTS_EACH = 20_000
#: Bytes of descriptions of a task that makes postings.
BYTES_EACH = 10_000_000


def _fields() -> Column:
    """The texts of a product, whole, and their weights."""
    single = [("name", NAME), ("description", DESCRIPTION), ("brand", BRAND), ("category", CATEGORY), ("vendor_code", VENDOR_CODE)]
    of = [F.struct(F.col(c).alias("text"), F.lit(w).alias("weight")) for c, w in single]
    params = F.transform(F.coalesce(F.map_values("params"), F.array().cast("array<string>")), lambda v: F.struct(v.alias("text"), F.lit(PARAM).alias("weight")))
    return F.filter(F.concat(F.array(*of), params), lambda f: f["text"].isNotNull() & (f["text"] != ""))


def postings(catalog: DataFrame) -> DataFrame:
    """(project_id, token, product_id, score): the inverted index. Every occurrence of a token adds its field's weight.

    Products are dealt to tasks before they become postings, in as many parts as their number and their descriptions' length
    ask for: a file of a few MB is read by one task, whatever the number of its products. All postings of a product lie in
    its part, so that they are added up there and not shuffled.
    """
    catalog = _dealt(catalog)
    fields = catalog.select("project_id", F.col("id").alias("product_id"), F.explode(_fields()).alias("f"))
    tokens = fields.select("project_id", "product_id", F.explode(X.tokenize(X.normalize("f.text"))).alias("token"), F.col("f.weight").alias("weight"))
    return tokens.groupBy("project_id", "token", "product_id").agg(F.sum("weight").alias("score"))


def _dealt(catalog: DataFrame) -> DataFrame:
    products, length = catalog.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("description")), F.lit(0))).first()
    return catalog.repartition(1 + products // PRODUCTS_EACH + length // BYTES_EACH, "project_id", "id")


def ngram_index(posted: DataFrame, cut=X.ngrams) -> DataFrame:
    """(project_id, ngram, token), distinct, of the tokens of ``postings``."""
    tokens = posted.select("project_id", "token").distinct()
    return tokens.select("project_id", F.explode(F.array_distinct(cut("token"))).alias("ngram"), "token")


def suggest_index(catalog: DataFrame) -> DataFrame:
    """(project_id, prefix, freq): each product counts for every prefix of its tokenized name."""
    t = F.col("t")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_join(F.slice(t, F.lit(1), i), " "))
    named = catalog.select("project_id", X.tokenize(X.normalize("name")).alias("t")).where(F.size(t) > 0)
    return named.select("project_id", F.explode(prefixes).alias("prefix")).groupBy("project_id", "prefix").agg(F.count("*").alias("freq"))


def index_meta(catalog: DataFrame, posted: DataFrame) -> DataFrame:
    """(project_id, products_count, tokens_count, indexed_at)."""
    tokens = posted.groupBy("project_id").agg(F.countDistinct("token").alias("tokens_count"))
    return catalog.groupBy("project_id").agg(F.count("*").alias("products_count")).join(tokens, "project_id", "left").withColumn("indexed_at", F.current_timestamp())


def write_index(catalog: DataFrame, path: str) -> None:
    """Postings, n-grams and suggestions under ``path``; postings are laid out by token."""
    write = lambda df, name, *by: df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{path}/{name}")
    posted = postings(catalog)
    write(posted, "postings", "project_id", "token")
    # Of the projects that are written; those of others stay as they are.
    stored = catalog.sparkSession.read.parquet(f"{path}/postings").join(catalog.select("project_id").distinct(), "project_id", "left_semi")
    write(ngram_index(stored), "ngrams", "project_id", "ngram")
    write(suggest_index(catalog), "suggest", "project_id", "prefix")


def upsert(posted: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after some products changed: their old rows go, their new ones come."""
    ids = changed.select("project_id", F.col("id").alias("product_id")).distinct()
    return posted.join(ids, ["project_id", "product_id"], "left_anti").unionByName(postings(changed))


def delete(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """The catalog without the (project_id, id) of ``ids``."""
    return catalog.join(ids.select("project_id", "id").distinct(), ["project_id", "id"], "left_anti")


def clear(df: DataFrame, project_id: str) -> DataFrame:
    return df.where(~F.col("project_id").eqNullSafe(F.lit(project_id)))


def merge_delta(catalog: DataFrame, delta: DataFrame, project_id: str = DEMO) -> DataFrame:
    """The catalog after price and stock changes of a project (id, price, old_price, in_stock, quantity; null: not supplied).

    Only known ids of that project are touched; of changes of one id the last in the input counts. ``changed`` is true where price or stock differ, or an old price or quantity came.
    """
    d = latest(delta.select(F.lit(project_id).alias("project_id"), "id", *(F.col(c).alias(f"new_{c}") for c in ("price", "old_price", "in_stock", "quantity"))))
    joined = catalog.join(d, ["project_id", "id"], "left")
    differs = lambda c: F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c))
    changed = differs("price") | differs("in_stock") | F.col("new_old_price").isNotNull() | F.col("new_quantity").isNotNull()
    quantity = F.coalesce("new_quantity", "quantity") if "quantity" in catalog.columns else F.col("new_quantity")
    out = joined.withColumns({"changed": F.coalesce(changed, F.lit(False)), "quantity": quantity, **{c: F.coalesce(f"new_{c}", c) for c in ("price", "old_price", "in_stock")}})
    out = out.drop(*(f"new_{c}" for c in ("price", "old_price", "in_stock", "quantity")))
    cheaper = (F.col("price") != 0) & (F.col("old_price") > F.col("price"))
    return out.withColumn("discount_percent", F.when(cheaper, F.bround((1 - F.col("price") / F.col("old_price")) * 100, 0).cast("int")))


def restocked(posted: DataFrame, before: DataFrame, after: DataFrame, scored=postings) -> DataFrame:
    """Postings after stock changed: scores of products that ran out are halved, those of products that came back are computed
    anew by ``scored``, which made the postings."""
    ids = lambda df, name: df.select("project_id", F.col("id").alias("product_id"), F.coalesce("in_stock", F.lit(True)).alias(name))
    flips = ids(before, "was").join(ids(after, "now"), ["project_id", "product_id"]).where("was <> now")
    back = flips.where("now").select("project_id", "product_id")
    kept = posted.join(back, ["project_id", "product_id"], "left_anti").join(flips.where("was").select("project_id", "product_id", "was"), ["project_id", "product_id"], "left")
    halved = kept.withColumn("score", F.when(F.col("was"), F.col("score") * 0.5).otherwise(F.col("score"))).drop("was")
    return halved.unionByName(scored(after.join(back.withColumnRenamed("product_id", "id"), ["project_id", "id"], "left_semi")))


def token_document_counts(posted: DataFrame, limit: int = 20) -> DataFrame:
    """(token, products): the most frequent tokens, ties by token."""
    return posted.groupBy("token").agg(F.count("*").alias("products")).orderBy(F.desc("products"), "token").limit(limit)


def index_stats(posted: DataFrame) -> DataFrame:
    """(tokens, products, postings) of an index."""
    return posted.agg(F.countDistinct("token").alias("tokens"), F.countDistinct("product_id").alias("products"), F.count("*").alias("postings"))


# The richer index, which scores a token by where it stands.


def token_set(catalog: DataFrame) -> DataFrame:
    """(project_id, product_id, token), distinct: name tokens and their stems, brand, category, 50 description tokens, 10
    tokens of each attribute."""
    tokens = lambda c: X.tokenize_split(X.normalize(F.coalesce(c, F.lit(""))))
    name = tokens(F.col("name"))
    params = F.flatten(F.transform(F.coalesce(F.map_values("params"), F.array().cast("array<string>")), lambda v: F.slice(tokens(v), 1, 10)))
    every = F.concat(name, F.transform(name, X.stem), tokens(F.col("brand")), tokens(F.col("category")), F.slice(tokens(F.col("description")), 1, 50), params)
    return catalog.select("project_id", F.col("id").alias("product_id"), F.explode(F.array_distinct(every)).alias("token"))


def placed_postings(catalog: DataFrame) -> DataFrame:
    """(project_id, product_id, token, score): a token scores by the fields that contain it and by its place in the name."""
    fields = catalog.select("project_id", F.col("id").alias("product_id"), *(F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "brand", "category", "description")), "in_stock")
    rows = token_set(catalog).join(fields, ["project_id", "product_id"])
    at = F.instr("name", F.col("token"))
    has = lambda c: F.contains(F.col(c), F.col("token")).cast("double")
    by_name = F.when(at > 0, 1.0 - 0.5 * (at - 1) / F.greatest(F.length("name"), F.lit(1))).otherwise(0.0)
    score = by_name + 0.5 * has("brand") + 0.3 * has("category") + 0.2 * has("description")
    return rows.select("project_id", "product_id", "token", F.bround(score * F.when(F.coalesce("in_stock", F.lit(True)), 1.0).otherwise(0.5), 4).alias("score"))


def suggest_phrases(catalog: DataFrame) -> DataFrame:
    """The suggestions with the first three characters as their bucket."""
    return suggest_index(catalog).withColumn("prefix3", F.substring("prefix", 1, 3))
