"""The catalog table: its schema, its adapter over the test tables, its snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("project_id", "id", "name", "description", "url", "image")]
    + [T.StructField("price", T.DoubleType()), T.StructField("old_price", T.DoubleType()), T.StructField("in_stock", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("category", "category_id", "brand", "vendor_code")]
    + [T.StructField("params", T.MapType(T.StringType(), T.StringType()))]
)
#: What a document may carry beside these.
EXTENSION = "images array<string>, currency string, quantity int, categories array<string>, attributes map<string,string>, discount_percent int, popularity double"
DEMO = "demo"


def from_rows(spark: SparkSession, rows: list[dict], project_id: str = DEMO) -> DataFrame:
    """A catalog of literal rows; what a row lacks is null, and in_stock true."""
    full = [tuple({"project_id": project_id, "in_stock": True, **r}.get(f.name) for f in SCHEMA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``part`` table as a catalog: every column derives from the part's own."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    return p.select(
        F.lit(DEMO).alias("project_id"),
        key.cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.concat(F.lit("https://shop.example/"), key.cast("string")).alias("url"),
        F.lit(None).cast("string").alias("image"),
        F.col("p_retailprice").alias("price"),
        F.when(key % 3 == 0, F.col("p_retailprice") * 1.25).alias("old_price"),
        (key % 7 != 0).alias("in_stock"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("c"), F.length("p_type").cast("string")).alias("category_id"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("PN-"), key.cast("string")).alias("vendor_code"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("color"), F.substring_index("p_name", " ", 1)).alias("params"),
    )


#: The project of requests that name none.
DEMO = "demo"


def of_project(df: DataFrame, project_id: str = DEMO) -> DataFrame:
    """The rows of one project: what is asked of a catalog or an index is asked of one tenant's."""
    return df.where(F.col("project_id") == project_id)


def latest(catalog: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each (project_id, id): the last by ``order``, or else by its place in the input (files in the order in which
    they are read, rows in that of their file)."""
    columns = [c for c in catalog.columns if c not in ("project_id", "id")]
    place = F.monotonically_increasing_id() if order is None else F.col(order)
    placed = catalog.select("project_id", "id", F.struct(*columns).alias("r"), place.alias("place"))
    picked = placed.groupBy("project_id", "id").agg(F.max_by("r", "place").alias("r"))
    return picked.select("project_id", "id", *(F.col(f"r.{c}").alias(c) for c in columns))


def with_discount(catalog: DataFrame) -> DataFrame:
    """Adds discount_percent: null unless there is a price and a higher old price."""
    both = (F.col("price") != 0) & (F.col("old_price") != 0) & (F.col("old_price") > F.col("price"))
    return catalog.withColumn("discount_percent", F.when(both, F.bround((1 - F.col("price") / F.col("old_price")) * 100, 0).cast("int")))


def by_ids(catalog: DataFrame, ids: list[str], project_id: str = DEMO) -> DataFrame:
    """The products of a project with these ids, in their order (column pos); missing ones are left out."""
    spark = catalog.sparkSession
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, pos int")
    return of_project(catalog, project_id).join(wanted, "id").orderBy("pos")


def page(catalog: DataFrame, limit: int = 100, offset: int = 0, project_id: str = DEMO) -> DataFrame:
    """A page of a project's catalog by id, with the number of its products beside each row."""
    rows = of_project(catalog, project_id)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("id").offset(offset).limit(limit).join(total)


def write(catalog: DataFrame, path: str) -> None:
    """Replaces the projects that occur in ``catalog`` and leaves the others as they are."""
    catalog.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def read(spark: SparkSession, path: str, project_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if project_id is None else df.where(F.col("project_id") == project_id)


def to_backup(catalog: DataFrame) -> DataFrame:
    """(project_id, product_id, data): each product as JSON, the last of equal ids."""
    return latest(catalog).select("project_id", F.col("id").alias("product_id"), F.to_json(F.struct(*[c for c in catalog.columns if c != "project_id"])).alias("data"))


def from_backup(backup: DataFrame) -> DataFrame:
    inner = T.StructType([f for f in SCHEMA if f.name != "project_id"])
    return backup.select("project_id", F.from_json("data", inner).alias("d")).select("project_id", "d.*")


def recovery_plan(projects: DataFrame, catalog: DataFrame, postings: DataFrame, backup: DataFrame) -> DataFrame:
    """What each project needs: restore (no products but a backup), rebuild (products without an index) or nothing."""
    have = lambda df, name: df.select("project_id").distinct().withColumn(name, F.lit(True))
    out = projects.select("project_id")
    for df, name in ((catalog, "products"), (postings, "indexed"), (backup, "saved")):
        out = out.join(have(df, name), "project_id", "left")
    step = F.when(F.col("products").isNull() & F.col("saved"), "restore").when(F.col("products") & F.col("indexed").isNull(), "rebuild").otherwise("none")
    return out.select("project_id", step.alias("step"))
