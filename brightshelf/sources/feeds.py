"""Feeds: YML, Google-style XML, JSON, CSV and stock updates, as DataFrames of one shape."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.words import STOCK_WORDS

# The names by which other formats call a product's fields, in the order in which they are tried; @ marks an
# attribute.
YML_FIELDS = {
    "id": ["@id", "id"],
    "name": ["name", "title"],
    "description": ["description"],
    "price": ["price"],
    "old_price": ["oldprice", "old_price"],
    "url": ["url"],
    "image": ["picture", "image"],
    "category": ["categoryId", "category"],
    "brand": ["vendor", "brand"],
    "in_stock": ["available", "in_stock"],
    "quantity": ["quantity", "stock_quantity"],
}
GOOGLE_FIELDS = {
    "id": ["g:id", "id"],
    "name": ["g:title", "title"],
    "description": ["g:description", "description"],
    "price": ["g:price", "price"],
    "url": ["g:link", "link"],
    "image": ["g:image_link", "image_link"],
    "category": ["g:product_type", "product_type"],
    "brand": ["g:brand", "brand"],
    "in_stock": ["g:availability", "availability"],
}
#: Where a JSON feed may keep its list of products, and a JSON stock update.
JSON_LISTS, JSON_UPDATES = ("products", "items", "offers", "data"), ("items", "products")
#: The elements that are a product in an XML feed, and in an XML stock update.
ROW_TAGS, UPDATE_TAGS = ("offer", "item", "product", "entry"), ("item", "offer", "product")

_S, _LS = T.StringType(), T.ArrayType(T.StringType())
_PARAM = T.ArrayType(T.StructType([T.StructField("_name", _S), T.StructField("_VALUE", _S)]))
OFFER = T.StructType(
    [T.StructField(n, _S) for n in ("_id", "_available", "name", "typePrefix", "vendor", "model", "price", "oldprice", "currencyId", "categoryId", "url", "description", "vendorCode")]
    + [T.StructField("picture", _LS), T.StructField("param", _PARAM)]
)
CATEGORY = T.StructType([T.StructField(n, _S) for n in ("_id", "_parentId", "_VALUE")])
SHOP = T.StructType([T.StructField(n, _S) for n in ("name", "company", "url")])


def unescape(c: Column) -> Column:
    """HTML entities decoded; there is no built-in for them, so texts without a ``&`` never leave the JVM's answer."""
    decode = F.pandas_udf(lambda s: s.map(lambda x: html.unescape(x) if isinstance(x, str) else x).astype(object).where(pd.notna(s), None), "string")
    return F.when(F.contains(c, F.lit("&")), decode(c)).otherwise(c)


def sniff(content: str, kind: str = "") -> str:
    """xml, json or csv by the format that is named, or else by the first character; xml where nothing tells."""
    start = content.lstrip()[:1]
    if kind == "xml" or start == "<":
        return "xml"
    if kind == "json" or start in ("{", "["):
        return "json"
    return "csv" if kind == "csv" else "xml"


def _xml(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("valueTag", "_VALUE").option("attributePrefix", "_").schema(schema).load(path)


def yml_categories(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "category", CATEGORY).select(F.col("_id").alias("id"), unescape(F.trim("_VALUE")).alias("name"), F.col("_parentId").alias("parent_id"))


def yml_shop(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "shop", SHOP).select("name", "company", "url")


def _last_of_each(pairs: Column) -> Column:
    """A map of an array of (k, v): of equal names the last one stays."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    last = F.filter(numbered, lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def offers(rows: DataFrame, categories: DataFrame, project_id: str = "demo") -> DataFrame:
    """Catalog rows of offers (the shape of OFFER) and categories (id, name)."""
    text = lambda c: unescape(F.coalesce(c, F.lit("")))
    o = rows.withColumns({c: text(c) for c in ("name", "vendor", "model", "description", "vendorCode", "typePrefix")})
    built = F.array_join(F.filter(F.array("typePrefix", "vendor", "model"), lambda x: x != ""), " ")
    pairs = F.filter(F.coalesce("param", F.array().cast(_PARAM)), lambda p: F.coalesce(p["_name"], F.lit("")) != "")
    pairs = F.transform(pairs, lambda p: F.struct(p["_name"].alias("k"), F.coalesce(p["_VALUE"], F.lit("")).alias("v")))
    o = o.select("*", _last_of_each(pairs).alias("params"))
    named = o.join(categories.select(F.col("id").alias("categoryId"), F.col("name").alias("category")), "categoryId", "left")
    return named.where(F.coalesce("_id", F.lit("")) != "").select(
        F.lit(project_id).alias("project_id"),
        F.col("_id").alias("id"),
        F.when(F.col("name") != "", F.col("name")).otherwise(built).alias("name"),
        "description",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.try_element_at("picture", F.lit(1)), F.lit("")).alias("image"),
        F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)).alias("price"),
        F.col("oldprice").try_cast("double").alias("old_price"),
        (F.lower(F.coalesce("_available", F.lit("true"))) == "true").alias("in_stock"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("categoryId", F.lit("")).alias("category_id"),
        F.col("vendor").alias("brand"),
        F.col("vendorCode").alias("vendor_code"),
        "params",
        F.coalesce("picture", F.array().cast(_LS)).alias("images"),
        F.coalesce("currencyId", F.lit("RUB")).alias("currency"),
    )


def read_yml(spark: SparkSession, path: str, project_id: str = "demo") -> DataFrame:
    return offers(_xml(spark, path, "offer", OFFER), yml_categories(spark, path), project_id)


def _records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(value): what stands between two ends of an element; files are read in splits, whose borders Spark moves to such an end."""
    return spark.read.option("lineSep", f"</{tag}>").text(path)


def splittable(spark: SparkSession, path: str, tag: str) -> bool:
    """Whether elements() finds the rows of an XML file: it is UTF-8, and no comment or CDATA section holds the element's end."""
    closed = lambda a, b: F.size(F.split("value", a)) == F.size(F.split("value", b))
    return _records(spark, path, tag).where(~(closed(r"<!\[CDATA\[", r"\]\]>") & closed("<!--", "-->") & F.is_valid_utf8("value"))).isEmpty()


def _elements(records: DataFrame, tag: str, whole: bool) -> DataFrame:
    """(value): the elements of a name as text. With ``whole`` a record holds their ends, else it was cut at one."""
    attributes = """(?:[^>"'/]|"[^"]*"|'[^']*'|/(?!>))*"""
    empty = rf"<{tag}(?=[\s/]){attributes}/>"
    if whole:
        return records.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s){empty}|<{tag}(?=[\s>]){attributes}>.*?</{tag}>"), F.lit(0))).alias("value"))
    begun = F.nullif(F.regexp_extract("value", rf"(?s).*(<{tag}(?=[\s>]){attributes}>.*)", 1), F.lit(""))
    last = F.filter(F.array(F.concat(begun, F.lit(f"</{tag}>"))), lambda x: x.isNotNull())
    return records.select(F.explode(F.concat(F.regexp_extract_all("value", F.lit(empty), F.lit(0)), last)).alias("value"))


def elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(value): the elements of a name as text, several tasks for one large file. An element does not hold others of its name."""
    return _elements(_records(spark, path, tag), tag, False)


def _parsed(values: DataFrame, tag: str, schema: T.StructType) -> DataFrame:
    return values.select(F.from_xml("value", schema.simpleString(), {"rowTag": tag, "attributePrefix": "_", "valueTag": "_VALUE"}).alias("e")).select("e.*")


def read_yml_split(spark: SparkSession, path: str, project_id: str = "demo") -> DataFrame:
    """read_yml() for files larger than a task: they are read in byte ranges, where ``splittable`` says that this is possible.
    The list of categories lies before the offers or after them, so it is within what the ends of two offers enclose."""
    if not splittable(spark, path, "offer"):
        return read_yml(spark, path, project_id)
    listed = _elements(_records(spark, path, "offer").where(F.contains("value", F.lit("<category"))), "category", True)
    categories = _parsed(listed, "category", CATEGORY).select(F.col("_id").alias("id"), unescape(F.trim("_VALUE")).alias("name"))
    return offers(_parsed(elements(spark, path, "offer"), "offer", OFFER), categories, project_id)


def mapped(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """The fields of a product by the first of its candidate columns that has a value; rows without an id are dropped.

    ``@x`` is the column ``_x``; a name with a prefix is also looked for without it. Of several pictures all are images.
    ``attributes`` are the params that have a name and a text.
    """

    def pick(candidates: list[str]) -> Column:
        found = []
        for c in candidates:
            for name in dict.fromkeys((c.replace("@", "_"), c.rpartition(":")[2].replace("@", "_"))):
                if name in rows.columns:
                    value = F.col(f"`{name}`")
                    if isinstance(rows.schema[name].dataType, T.ArrayType):
                        value = F.try_element_at(value, F.lit(1))
                    found.append(F.nullif(F.trim(value.cast("string")), F.lit("")))
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    picture = next((c for c in ("picture", "g:additional_image_link") if c in rows.columns and isinstance(rows.schema[c].dataType, T.ArrayType)), None)
    images = F.when(F.size(f"`{picture}`") > 1, F.col(f"`{picture}`")) if picture else F.lit(None).cast(_LS)
    return rows.select(*(pick(c).alias(f) for f, c in names.items()), images.alias("images"), _attributes(rows).alias("attributes")).where(F.col("id").isNotNull())


def _attributes(rows: DataFrame) -> Column:
    kind = rows.schema["param"].dataType if "param" in rows.columns else None
    one = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(one, T.StructType) or not {"_name", "_VALUE"} <= set(one.names):
        return F.create_map().cast("map<string,string>")
    params = F.col("param") if isinstance(kind, T.ArrayType) else F.when(F.col("param").isNotNull(), F.array("param"))
    pairs = F.transform(F.coalesce(params, F.array().cast(T.ArrayType(one))), lambda p: F.struct(p["_name"].alias("k"), p["_VALUE"].alias("v")))
    return _last_of_each(F.filter(pairs, lambda p: (F.coalesce(p["k"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != "")))


def _any_xml(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("valueTag", "_VALUE").option("attributePrefix", "_").option("inferSchema", False).load(path)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Any XML feed: all its rows by ROW_TAGS. Its fields have the names of YML if it has a catalog or an offer, else Google's."""
    offer = spark.read.text(path).where(F.contains("value", F.lit("<yml_catalog")) | F.contains("value", F.lit("<offer")))
    names = GOOGLE_FIELDS if offer.isEmpty() else YML_FIELDS
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (mapped(_any_xml(spark, path, tag), names) for tag in ROW_TAGS))


def _json_rows(spark: SparkSession, path: str, lists: tuple[str, ...]) -> DataFrame:
    """A list of products, or the first list under one of the known names."""
    rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    for name in lists:
        if name in rows.columns and isinstance(rows.schema[name].dataType, T.ArrayType):
            return rows.select(F.explode(name).alias("p")).select("p.*")
    return rows


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return mapped(_json_rows(spark, path, JSON_LISTS), YML_FIELDS)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV feed with a header, in UTF-8, or in windows-1251 where any line is no UTF-8."""
    read = spark.read.option("header", True)
    if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
        return mapped(read.csv(path), YML_FIELDS)
    # Read as one character a byte, which then stands for its letter.
    rows = read.option("encoding", "iso-8859-1").csv(path)
    upper = bytes(range(0x80, 0x100))
    byte, letter = upper.decode("latin-1"), upper.decode("cp1251", "replace")
    names = str.maketrans(byte, letter)
    return mapped(rows.select(*(F.translate(F.col(f"`{c}`"), byte, letter).alias(c.translate(names)) for c in rows.columns)), YML_FIELDS)


def _kind(spark: SparkSession, path: str, kind: str) -> str:
    first = spark.read.text(path).where(F.trim("value") != "").first()
    return sniff(first[0].lstrip("\ufeff") if first else "", kind)


def read(spark: SparkSession, path: str, kind: str = "") -> DataFrame:
    """mapped() rows of a feed of any format: that which ``kind`` names, or what its first character tells."""
    return {"xml": read_xml, "json": read_json, "csv": read_csv}[_kind(spark, path, kind)](spark, path)


def read_delta(spark: SparkSession, path: str, kind: str = "") -> DataFrame:
    """delta() rows of a stock update in XML (any of UPDATE_TAGS) or JSON; other formats have none."""
    found = _kind(spark, path, kind)
    if found == "json":
        return delta(_json_rows(spark, path, JSON_UPDATES))
    if found == "csv":
        return delta(spark.createDataFrame([], "id string"))
    return reduce(DataFrame.unionByName, (delta(_any_xml(spark, path, tag)) for tag in UPDATE_TAGS))


def transformed(raw: DataFrame, project_id: str = "demo") -> DataFrame:
    """Catalog rows of mapped() rows: prices and truth values parsed, texts cleaned, rows with a senseless price dropped."""
    get = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    out = raw.select(
        F.lit(project_id).alias("project_id"),
        "id",
        X.strip_html("name").alias("name"),
        X.strip_html(get("description")).alias("description"),
        get("url").alias("url"),
        get("image").alias("image"),
        X.parse_price(get("price")).alias("price"),
        F.when(get("old_price").isNotNull(), X.parse_price(get("old_price"))).alias("old_price"),
        F.when(get("in_stock").isNull(), True).otherwise(X.parse_bool(get("in_stock"))).alias("in_stock"),
        get("category").alias("category"),
        F.lit(None).cast("string").alias("category_id"),
        get("brand").alias("brand"),
        F.lit(None).cast("string").alias("vendor_code"),
        (F.col("attributes") if "attributes" in raw.columns else F.create_map().cast("map<string,string>")).alias("params"),
        get("quantity").try_cast("int").alias("quantity"),
    )
    return out.where(F.col("price").isNotNull())


def problems(raw: DataFrame) -> DataFrame:
    """``raw`` (id, name, url, price as strings) with ``errors``: what is wrong with each row."""
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in ("id", "name", "url")]
    bad = F.when((F.coalesce(F.trim("price"), F.lit("")) != "") & X.parse_price("price").isNull(), F.lit("invalid price"))
    return raw.withColumn("errors", F.filter(F.array(*missing, bad), lambda e: e.isNotNull()))


def validated(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with some)"""
    rows = problems(raw)
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def delta(rows: DataFrame) -> DataFrame:
    """Stock updates (id, price, old_price, in_stock, quantity) of rows of strings; what is not given is null."""
    get = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in rows.columns), F.lit(None).cast("string"))
    stock = get("_available", "available", "in_stock")
    return rows.select(
        get("_id", "id").alias("id"),
        X.parse_delta_price(get("price")).alias("price"),
        X.parse_delta_price(get("oldprice", "old_price")).alias("old_price"),
        F.when(stock.isNotNull(), X.parse_bool(stock, STOCK_WORDS)).alias("in_stock"),
        get("quantity", "stock_quantity").try_cast("int").alias("quantity"),
    ).where(F.coalesce("id", F.lit("")) != "")


def run_row(spark: SparkSession, project_id: str, url: str, status: str, processed: int, errors: int, message: str = "", updated: int = 0, duration_ms: int = 0) -> DataFrame:
    """A row of the feed-run log, to be appended."""
    row = [(project_id, url, status, processed, errors, message, updated, duration_ms)]
    return spark.createDataFrame(row, "project_id string, url string, status string, processed long, errors long, message string, updated long, duration_ms long").withColumn("ts", F.current_timestamp())
