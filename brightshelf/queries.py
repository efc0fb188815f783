"""One query for each operator over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as O
from .functions import text as X
from .functions import words as W
from .operators import analytics, cells, facets, impact, index, ranking, related, search, spell, suggest, vectors
from .plans import hybrid, requests, rich
from .plans.results import Results
from .plans.shop import Shop
from .sources import catalog as C
from .sources import feeds
from .sources.snapshots import Snapshots
from .streaming import counters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHOPS: dict[tuple[str, str], Shop] = {}


def stored(spark: SparkSession, sf_dir: str) -> Shop:
    """The catalog and its index in the shared folder, made once in an application: searches read an index, they do not make it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHOPS:
        _SHOPS[key] = new_shop(spark, "plain")
        _SHOPS[key].replace(C.from_parts(spark, sf_dir), C.DEMO)
    return _SHOPS[key]


def new_shop(spark: SparkSession, kind: str) -> Shop:
    return Shop(spark, counters.shared_folder(spark, "shop"), kind)


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, search.Index]:
    return C.from_parts(spark, sf_dir), stored(spark, sf_dir).index()


def asked(spark: SparkSession, queries: list[tuple[str, int]]) -> DataFrame:
    return requests.of_queries(spark, [q for q, _ in queries], [n for _, n in queries])


PARTS = "FROM part"
DAY = date(2024, 1, 20)

# Text.


@query(f"SELECT doc_id, md5({O.normalize('text')}) AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize("text")).alias("normalized"))


@query(f"SELECT p_partkey AS id, array_to_string({O.tokenize(O.normalize(chr(39) + 'и ' + chr(39) + ' || p_name || ' + chr(39) + ' pn-' + chr(39) + ' || p_partkey || ' + chr(39) + ' для x-y-' + chr(39) + ' || p_size'))}, '|') AS tokens FROM part")
def tokenize(spark, sf_dir):
    said = F.concat(F.lit("и "), "p_name", F.lit(" pn-"), F.col("p_partkey").cast("string"), F.lit(" для x-y-"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.tokenize(X.normalize(said)), "|").alias("tokens"))


@query("SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(" + O.normalize("text") + ", '[\\s\\-]+'), lambda w: length(w) > 1 AND NOT list_contains(" + O.strings(W.LONG_STOP_WORDS) + ", w)) AS t FROM documents)")
def tokenize_long(spark, sf_dir):
    t = X.tokenize_split(X.normalize("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query(f"SELECT p_partkey AS id, array_to_string({O.variants('p_name')}, '|') AS variants FROM part")
def layout_variants(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.layout_variants("p_name"), "|").alias("variants"))


_TYPED = f"SELECT unnest([p_name, {O.layout('p_name')}, p_name || ' ' || {O.layout('p_name')}, p_size::VARCHAR]) AS word FROM part"


@query(f"SELECT DISTINCT word, regexp_matches(lower(word), '[а-яё]') <> regexp_matches(lower(word), '[a-z]') AS wrong FROM ({_TYPED})")
def wrong_layout(spark, sf_dir):
    russian = X.convert_layout("p_name")
    rows = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", russian, F.concat_ws(" ", "p_name", russian), F.col("p_size").cast("string"))).alias("word"))
    return rows.select("word", X.wrong_layout("word").alias("wrong")).distinct()


@query(f"SELECT DISTINCT p_name, array_to_string({O.ngrams('p_name')}, '|') AS ngrams, array_to_string({O.ngrams(chr(39) + '__' + chr(39) + ' || p_name || ' + chr(39) + '__' + chr(39))}, '|') AS padded, array_to_string({O.ngrams('left(p_name, 2)')}, '|') AS short FROM part")
def char_ngrams(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_name", F.array_join(X.ngrams(name), "|").alias("ngrams"), F.array_join(X.padded_ngrams(name), "|").alias("padded"), F.array_join(X.ngrams(F.substring(name, 1, 2)), "|").alias("short")).distinct()


_SUFFIXED = f"SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) || e AS word FROM part, (SELECT unnest({O.strings(('', *W.ENDINGS))}) AS e)"


@query(f"SELECT word, CASE WHEN length(word) <= 3 THEN word " + " ".join(f"WHEN word LIKE '%{e}' AND length(word) >= {len(e) + 2} THEN left(word, length(word) - {len(e)})" for e in W.ENDINGS) + f" ELSE word END AS stem FROM ({_SUFFIXED})")
def stem_suffix(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    ended = words.select(F.explode(F.transform(F.array(*map(F.lit, ("", *W.ENDINGS))), lambda e: F.concat("word", e))).alias("word")).distinct()
    return ended.select("word", X.stem("word").alias("stem"))


def _replaced(c: str, groups, letters, last=()) -> str:
    for a, b in groups:
        c = f"replace({c}, '{a}', '{b}')"
    c = f"translate({c}, '{letters[0]}', '{letters[1]}')"
    for a, b in last:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"SELECT DISTINCT p_name, {_replaced('lower(p_name)', W.TO_CYRILLIC_GROUPS, W.TO_CYRILLIC_LETTERS, W.TO_CYRILLIC_LAST)} AS cyrillic, {_replaced(_replaced('lower(p_name)', W.TO_CYRILLIC_GROUPS, W.TO_CYRILLIC_LETTERS, W.TO_CYRILLIC_LAST), W.TO_LATIN_GROUPS, W.TO_LATIN_LETTERS)} AS back, p_name IN ('nike', 'lg') AS brand FROM part")
def transliterate(spark, sf_dir):
    there = X.transliterate("p_name")
    return table(spark, sf_dir, "part").select("p_name", there.alias("cyrillic"), X.transliterate(there, False).alias("back"), X.is_known_brand("p_name").alias("brand")).distinct()


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) AS cleaned FROM pages")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_html("html")).alias("cleaned"))


#: How a feed may write a number n, by the order's key.
_WRITTEN = "CASE {k} % 7 WHEN 0 THEN concat({n}, ' ', {k} % 900, ',50') WHEN 1 THEN concat({n}, '.5 руб') WHEN 2 THEN '' WHEN 3 THEN {s} WHEN 4 THEN concat('1.', {n}, ',9') WHEN 5 THEN concat('В ', 'наличии') ELSE 'True' END"
_WRITTEN_ORDERS = _WRITTEN.format(k="o_orderkey", n="cast(floor(o_totalprice) AS BIGINT)", s="o_orderstatus")


@query(f"SELECT id, v, CASE WHEN d = '' THEN 0.0 ELSE TRY_CAST(d AS DOUBLE) END AS price, lower(v) IN ({', '.join(map(O.text, W.TRUE_WORDS))}) AS yes FROM (SELECT id, v, regexp_replace(replace(replace(v, ',', '.'), ' ', ''), '[^0-9.]', '', 'g') AS d FROM (SELECT o_orderkey AS id, {_WRITTEN_ORDERS} AS v FROM orders))")
def parse_price_bool(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_WRITTEN_ORDERS).alias("v"))
    return rows.select("id", "v", X.parse_price("v").alias("price"), X.parse_bool("v").alias("yes"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(p_name, '(ring)', '<em>\\1</em>', 'gi'), '(re)', '<em>\\1</em>', 'gi') AS name FROM part")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.highlight("p_name", ["ring", "re"]).alias("name"))


@query("SELECT p_partkey AS id, md5(concat_ws('|', p_name, '20', '0', 'relevance')) AS key, concat_ws(' | ', p_name, p_brand, p_type) AS rerank, '/category/' || replace(lower(p_type), ' ', '-') AS slug FROM part")
def keys_and_texts(spark, sf_dir):
    cat = C.from_parts(spark, sf_dir)
    return cat.select(F.col("id").cast("long").alias("id"), X.cache_key("name", 20, 0, "relevance").alias("key"), X.rerank_text(("name", "brand", "category")).alias("rerank"), X.category_slug("category").alias("slug"))


@query("SELECT p_partkey AS id, replace(replace(replace(format('{:,.2f}', p_retailprice), ',', '_'), '.', ','), '_', ' ') AS money, replace(replace('<' || p_name || '>&', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') AS escaped FROM part")
def presentation(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.money("p_retailprice").alias("money"), X.escape_html(F.concat(F.lit("<"), "p_name", F.lit(">&"))).alias("escaped"))


# Index.


@query(O.with_(O.CATALOG, O.POSTINGS) + " SELECT token, product_id, score FROM postings")
def index_postings(spark, sf_dir):
    return index.postings(C.from_parts(spark, sf_dir)).drop("project_id")


@query(O.with_(O.CATALOG, O.POSTINGS, O.NGRAMS) + " SELECT ngram, token FROM ngrams")
def index_ngrams(spark, sf_dir):
    return index.ngram_index(index.postings(C.from_parts(spark, sf_dir))).drop("project_id")


SUGGEST = f"suggest AS (SELECT prefix, count(*) AS freq FROM (SELECT unnest(list_transform(range(1, len(t) + 1), lambda i: array_to_string(t[1:i], ' '))) AS prefix FROM (SELECT {O.tokenize(O.normalize('name'))} AS t FROM catalog)) GROUP BY prefix)"


@query(O.with_(O.CATALOG, SUGGEST) + " SELECT prefix, freq FROM suggest")
def index_suggest(spark, sf_dir):
    return index.suggest_index(C.from_parts(spark, sf_dir)).drop("project_id")


@query(O.with_(O.CATALOG, O.POSTINGS) + " SELECT (SELECT count(*) FROM catalog) AS products_count, count(DISTINCT token) AS tokens_count FROM postings")
def index_meta(spark, sf_dir):
    cat = C.from_parts(spark, sf_dir)
    return index.index_meta(cat, index.postings(cat)).select("products_count", "tokens_count")


@query(O.with_(O.CATALOG, O.POSTINGS) + " SELECT token, count(*) AS products FROM postings GROUP BY token ORDER BY products DESC, token LIMIT 20")
def index_top_tokens(spark, sf_dir):
    return index.token_document_counts(index.postings(C.from_parts(spark, sf_dir)))


_TOKEN_SET = "tk AS (SELECT id, unnest(list_distinct(list_concat(string_split(lower(name), ' '), list_filter(string_split(lower(replace(brand, '#', ' ')), ' '), lambda w: length(w) > 1), [lower(category)], list_filter([size], lambda w: length(w) > 1), [color]))) AS token, * FROM catalog)"
_PLACED_POSTINGS = """SELECT id AS product_id, token, round_even(((CASE WHEN instr(lower(name), token) > 0 THEN 1.0::DOUBLE - 0.5::DOUBLE * (instr(lower(name), token) - 1) / greatest(length(name), 1) ELSE 0 END)
  + 0.5::DOUBLE * contains(lower(brand), token)::INT + 0.3::DOUBLE * contains(lower(category), token)::INT) * (CASE WHEN in_stock THEN 1.0::DOUBLE ELSE 0.5 END), 4) AS score FROM tk"""


@query(O.with_(O.CATALOG, _TOKEN_SET) + " " + _PLACED_POSTINGS)
def index_placed_postings(spark, sf_dir):
    return index.placed_postings(C.from_parts(spark, sf_dir)).drop("project_id")


# Search.

BASIC = [("red ring", 20), ("brand 17", 20), ("Large-Economy", 10), ("red red widget", 5)]


@query(O.search(BASIC))
def search_basic(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return search.search(asked(spark, BASIC), idx, cat)


SYNONYMS = [["ring", "Anvil", "hoop"], ["red", "crimson", "rod"], ["rod", "bar"]]
SYN_QUERIES = [("crimson hoop", 15), ("bar", 15), ("ring", 10)]


@query(O.search(SYN_QUERIES, SYNONYMS))
def search_synonyms(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    groups = search.literal_rows(spark, [{"project_id": "demo", "group_pos": k, "words": g} for k, g in enumerate(SYNONYMS)], "project_id string, group_pos int, words array<string>")
    return search.search(asked(spark, SYN_QUERIES), idx, cat, synonyms=groups)


LAYOUT_QUERIES = [("кув кштп", 20), ("ыьфдд цшвпуе", 10)]


@query(O.search(LAYOUT_QUERIES))
def search_layout_fallback(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return search.search(asked(spark, LAYOUT_QUERIES), idx, cat)


NGRAM_QUERIES = [("widgetz", 25), ("gizm anvilo", 25), ("pn-7x", 30)]


@query(O.search(NGRAM_QUERIES))
def search_ngram_fallback(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return search.search(asked(spark, NGRAM_QUERIES), idx, cat)


@query(O.search(BASIC, order="price ASC, "))
def search_price_asc(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return search.search(asked(spark, BASIC), idx, cat, sort="price_asc")


@query(O.search(BASIC, order="price DESC, ", offset=5))
def search_price_desc_page(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return search.search(asked(spark, BASIC), idx, cat, sort="price_desc", offset=5)


@query(O.search([("red ring", 10_000)], products=True))
def search_stock_last(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return search.search(asked(spark, [("red ring", 10_000)]), idx, cat, facets=True)


FILTERS = {"min_price": 910.0, "max_price": 1050.0, "in_stock": True, "category": ["ECONOMY", "SMALL"], "params": {"color": ["red", "blue"]}}
WHERE = "in_stock AND category IN ('ECONOMY', 'SMALL') AND color IN ('red', 'blue')"
IN_PRICE = "price >= 910.0 AND price <= 1050.0"


@query(O.search(BASIC, where=f"{WHERE} AND {IN_PRICE}"))
def search_filtered(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return search.search(asked(spark, BASIC), idx, cat, filters=FILTERS)


COLORS, THINGS = ("red", "blue", "hot", "cold", "old", "new", "small", "large"), ("ring", "bolt", "gear", "gizmo", "widget", "rod", "plate", "anvil")
BATCH = [(f"{a} {b}{s}", 20) for s in ("", " economy", " brand", " promo") for a in COLORS for b in THINGS]


@query(O.search(BATCH))
def search_batch(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return search.search(asked(spark, BATCH), idx, cat)


@query(f"SELECT * EXCLUDE (total) FROM ({O.search(BASIC)})")
def search_topk(spark, sf_dir):
    return impact.top(asked(spark, BASIC), stored(spark, sf_dir).impacts(), C.from_parts(spark, sf_dir))


@query(f"SELECT * EXCLUDE (total) FROM ({O.search(BATCH)})")
def search_topk_batch(spark, sf_dir):
    return impact.top(asked(spark, BATCH), stored(spark, sf_dir).impacts(), C.from_parts(spark, sf_dir))


@query(O.search(BASIC))
def search_cached(spark, sf_dir):
    results, shop = Results(Snapshots(spark, counters.shared_folder(spark, "results"))), stored(spark, sf_dir)
    results.search(shop, asked(spark, BASIC[:2]))
    return results.search(shop, asked(spark, BASIC))


# Facets and fields.


def _facet_rows(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return facets.products(search.candidates(asked(spark, BASIC), idx), cat, FILTERS)


@query(O.faceted(BASIC, WHERE, f"SELECT query_id, value, count, row_number() OVER (PARTITION BY query_id ORDER BY count DESC, seen) AS position FROM (SELECT query_id, category AS value, count(*) AS count, min(rank) AS seen FROM passing WHERE {IN_PRICE} GROUP BY ALL)"))
def facet_categories(spark, sf_dir):
    return facets.categories(_facet_rows(spark, sf_dir), FILTERS)


@query(O.faceted(BASIC, WHERE, "SELECT query_id, min(price) AS min, max(price) AS max FROM passing GROUP BY query_id"))
def facet_price_range(spark, sf_dir):
    return facets.price_bounds(_facet_rows(spark, sf_dir))


_PRICED = f", priced AS (SELECT * FROM passing WHERE {IN_PRICE}), {O.PAIRS}, {O.PARAM_COUNTS}"
_SHOWN = "SELECT query_id, key, key_position, value, count, value_position FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY count DESC, value) AS value_position FROM counts JOIN picked USING (query_id, key)) WHERE value_position <= 20"


@query(O.faceted(BASIC, WHERE, "@").replace("\n@", f"{_PRICED}, totals AS (SELECT query_id, count(*) AS total FROM priced GROUP BY 1), ks AS (SELECT query_id, key, sum(count) AS having_, count(*) AS d, min(seen) AS s FROM counts GROUP BY ALL), picked AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY having_::DOUBLE / total DESC, s) AS key_position FROM ks JOIN totals USING (query_id) WHERE having_::DOUBLE / total >= 0.05 AND d::DOUBLE / having_ <= 0.8)\n{_SHOWN}"))
def facet_params_auto(spark, sf_dir):
    return facets.params(_facet_rows(spark, sf_dir), FILTERS)


@query(O.faceted(BASIC, WHERE, "@").replace("\n@", f"{_PRICED}, picked AS (SELECT DISTINCT query_id, key, CASE key WHEN 'color' THEN 1 ELSE 2 END AS key_position FROM counts)\n{_SHOWN}"))
def facet_params_explicit(spark, sf_dir):
    return facets.params(_facet_rows(spark, sf_dir), FILTERS, ["color", "size"])


@query(
    "SELECT query_id, 'category' AS facet, NULL AS key, NULL AS key_position, value, count, position, NULL AS min, NULL AS max FROM (" + SQL["facet_categories"] + ") UNION ALL SELECT query_id, 'price', NULL, NULL, NULL, count, 1, min, max FROM ("
    + SQL["facet_price_range"].replace("max(price) AS max", "max(price) AS max, count(*) AS count") + ") UNION ALL SELECT query_id, 'param', key, key_position, value, count, value_position, NULL, NULL FROM (" + SQL["facet_params_auto"] + ")"
)
def facets_together(spark, sf_dir):
    return facets.together(_facet_rows(spark, sf_dir), FILTERS)


@query("SELECT p_type AS category, count(*) AS count, (SELECT count(*) FROM part) AS total_products FROM part GROUP BY p_type")
def category_counts(spark, sf_dir):
    return facets.category_counts(C.from_parts(spark, sf_dir))


@query("SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 50")
def field_values(spark, sf_dir):
    return facets.field_values(C.from_parts(spark, sf_dir), "params.size")


@query("SELECT unnest(['brand', 'category', 'category_id', 'vendor_code', 'params.color', 'params.size']) AS field")
def field_discovery(spark, sf_dir):
    return facets.fields(C.from_parts(spark, sf_dir))


@query("WITH p AS (SELECT p_retailprice AS price FROM part WHERE p_retailprice > 0), b AS (SELECT min(price) AS lo, (max(price) - min(price)) / 4 AS step FROM p), r AS (SELECT k::INT AS bucket, lo + step * k AS a, lo + step * (k + 1) AS b FROM b, range(4) t(k)) SELECT bucket, round_even(a, 0) AS min, round_even(b, 0) AS max, (SELECT count(*) FROM p WHERE price >= a AND price < b) AS count FROM r")
def price_buckets(spark, sf_dir):
    return facets.price_buckets(C.from_parts(spark, sf_dir))


# Catalog.

IDS = ["17", "3", "nope", "100"]


@query(O.with_(O.CATALOG) + " SELECT id, pos::INT AS pos, name, price FROM catalog JOIN (VALUES ('17', 0), ('3', 1), ('nope', 2), ('100', 3)) w(id, pos) USING (id)")
def products_by_ids(spark, sf_dir):
    return C.by_ids(C.from_parts(spark, sf_dir), IDS).select("id", "pos", "name", "price")


@query(O.with_(O.CATALOG) + " SELECT id, name, (SELECT count(*) FROM catalog) AS total FROM catalog ORDER BY id LIMIT 20 OFFSET 40")
def catalog_page(spark, sf_dir):
    return C.page(C.from_parts(spark, sf_dir), 20, 40).select("id", "name", "total")


@query(O.with_(O.CATALOG) + " SELECT id, CASE WHEN old_price > price THEN round_even((1 - price / old_price) * 100, 0)::INT END AS discount_percent FROM catalog")
def discounts(spark, sf_dir):
    return C.with_discount(C.from_parts(spark, sf_dir)).select("id", "discount_percent")


@query(O.with_(O.CATALOG) + " SELECT id, name, price, old_price, in_stock, size, color FROM catalog")
def backup_round_trip(spark, sf_dir):
    back = C.from_backup(C.to_backup(C.from_parts(spark, sf_dir)))
    return back.select("id", "name", "price", "old_price", "in_stock", F.col("params")["size"].alias("size"), F.col("params")["color"].alias("color"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS project_id, CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 5 = 0 THEN 'restore' WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'rebuild' ELSE 'none' END AS step FROM customer")
def recovery_plan(spark, sf_dir):
    k = F.col("c_custkey")
    of = lambda n: table(spark, sf_dir, "customer").where(k % n == 0).select(k.cast("string").alias("project_id"))
    return C.recovery_plan(of(1), of(2), of(3), of(5))


@query("SELECT count(DISTINCT token) AS tokens, count(DISTINCT product_id) AS products, count(*) AS postings FROM (" + O.with_(O.CATALOG, O.POSTINGS) + " SELECT * FROM postings)")
def index_stats(spark, sf_dir):
    return index.index_stats(index.postings(C.from_parts(spark, sf_dir)))


# Suggestions, related products, recommendations.


@query(O.with_(O.CATALOG, SUGGEST) + " SELECT prefix, freq FROM suggest WHERE starts_with(prefix, 're') ORDER BY freq DESC, prefix DESC LIMIT 10")
def suggest_prefix(spark, sf_dir):
    return suggest.suggest(index.suggest_index(C.from_parts(spark, sf_dir)), "Re", 10)


@query(O.with_(O.CATALOG, SUGGEST) + " SELECT prefix, freq, '<em>red r</em>' || substring(prefix, 6) AS highlight FROM (SELECT * FROM suggest WHERE left(prefix, 3) = 'red' ORDER BY freq DESC, prefix DESC LIMIT 11) WHERE starts_with(prefix, 'red r') ORDER BY freq DESC, prefix DESC LIMIT 5")
def suggest_bucketed(spark, sf_dir):
    return suggest.suggest_bucketed(index.suggest_phrases(C.from_parts(spark, sf_dir)), "red r", 5)


@query("SELECT p_type AS category, count(*) AS count, '/category/' || lower(p_type) AS slug FROM part WHERE contains(lower(p_type), 'm') GROUP BY p_type ORDER BY count DESC, category LIMIT 3")
def suggest_categories(spark, sf_dir):
    return suggest.suggest_categories(C.from_parts(spark, sf_dir), "M")


@query(O.search([("small ring", 8)]).replace(O.ROW, "position, c.id, c.name"))
def suggest_products(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    parts = requests.suggest_request(spark, index.suggest_index(cat), idx, cat, "small ring")
    return parts["products"].select("position", "id", "name")


@query(O.with_(O.CATALOG) + " SELECT id, name FROM catalog WHERE lower(color) = 'red' AND id NOT IN ('1', '7') ORDER BY id LIMIT 4")
def related_by_field(spark, sf_dir):
    return related.by_field(C.from_parts(spark, sf_dir), "params.color", "RED", 4, ["1", "7"]).select("id", "name")


RELATED = ("brand", "params.color")


def _related_sql() -> str:
    page = O.search(BASIC).replace(f"SELECT {O.ROW}", "SELECT query_id, position, c.id")
    head, _, tail = page.rpartition("\nSELECT query_id")
    return (
        head
        + f", page AS (SELECT query_id{tail}), top AS (SELECT query_id, c.brand, c.color FROM page p JOIN catalog c USING (id) WHERE position = 1), seen AS (SELECT query_id, id FROM page WHERE position <= 5)"
        + ", g0 AS (SELECT * FROM (SELECT t.query_id, 'brand' AS field, row_number() OVER (PARTITION BY t.query_id ORDER BY c.id) AS position, c.id FROM top t JOIN catalog c ON c.brand = t.brand WHERE (t.query_id, c.id) NOT IN (SELECT query_id, id FROM seen)) WHERE position <= 4)"
        + ", g1 AS (SELECT * FROM (SELECT t.query_id, 'params.color' AS field, row_number() OVER (PARTITION BY t.query_id ORDER BY c.id) AS position, c.id FROM top t JOIN catalog c ON c.color = t.color WHERE (t.query_id, c.id) NOT IN (SELECT query_id, id FROM seen UNION ALL SELECT query_id, id FROM g0)) WHERE position <= 4)"
        + " SELECT * FROM g0 UNION ALL SELECT * FROM g1"
    )


@query(_related_sql())
def related_groups(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return related.related_groups(search.search(asked(spark, BASIC), idx, cat), cat, list(RELATED))


_POPULAR = "pop AS (SELECT product_id, count(*) AS clicks FROM clicks GROUP BY 1 ORDER BY clicks DESC, product_id DESC LIMIT 200)"


@query(
    O.with_(O.CATALOG, O.LOG, _POPULAR, "inc AS (SELECT * FROM catalog WHERE category = 'ECONOMY')")
    + """, st AS (SELECT id, 0 AS stage, lpad(CAST(k AS VARCHAR), 10, '0') AS place FROM inc JOIN (VALUES ('3', 0), ('0', 1), ('2', 2)) m(id, k) USING (id)
  UNION ALL SELECT id, 1, id FROM inc WHERE lower(color) IN ('red') AND lower(brand) IN ('brand#17', 'brand#2')
  UNION ALL SELECT id, 2, lpad(CAST(row_number() OVER (ORDER BY clicks DESC, product_id DESC) AS VARCHAR), 10, '0') FROM pop JOIN inc ON id = product_id)
, one AS (SELECT id, min({'stage': stage, 'place': place}) AS m FROM st GROUP BY id)
SELECT id, name, CASE m.stage WHEN 0 THEN 'manual' WHEN 1 THEN 'attribute' ELSE 'popular' END AS stage, (row_number() OVER (ORDER BY m.stage, m.place))::INT AS position FROM one JOIN catalog USING (id) ORDER BY m.stage, m.place LIMIT 8"""
)
def recommend_waterfall(spark, sf_dir):
    cat = C.from_parts(spark, sf_dir)
    clicks = analytics.product_clicks(_clicks(spark, sf_dir))
    return related.recommend(cat, clicks, "ECONOMY", 8, ["3", "0", "2"], {"params.color": ["Red"], "brand": ["Brand#17", "Brand#2"]})


@query(O.with_(O.CATALOG) + ", s AS (SELECT id FROM catalog WHERE in_stock ORDER BY id LIMIT 6) SELECT id, name, 'fallback' AS stage, (row_number() OVER (ORDER BY id))::INT AS position FROM s JOIN catalog USING (id)")
def recommend_fallback(spark, sf_dir):
    nobody = spark.createDataFrame([], "product_id string, clicks long")
    return related.recommend(C.from_parts(spark, sf_dir), nobody, None, 6)


@query(O.with_(O.CATALOG) + ", p AS (SELECT a.id, b.id AS similar_id, row_number() OVER (PARTITION BY a.id ORDER BY b.name, b.id) AS position FROM catalog a JOIN catalog b ON a.brand = b.brand AND contains(lower(b.category), lower(a.category)) AND b.price BETWEEN a.price * 0.7::DOUBLE AND a.price * 1.3::DOUBLE AND a.id <> b.id) SELECT * FROM p WHERE position <= 5")
def similar_products(spark, sf_dir):
    return related.similar_within(C.from_parts(spark, sf_dir), limit=5)


# Analytics.


def _log(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").where("event_type = 'view'")
    return rows.select("ts", F.concat(F.lit("query "), k).alias("query"), (k.cast("int") % 5).alias("results_count"), F.col("value").alias("took_ms"), "event_id")


def _clicks(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").where("event_type = 'click'")
    return rows.select("ts", k.alias("product_id"), F.concat(F.lit(" Query  "), (k.cast("int") % 10).cast("string"), F.lit(" ")).alias("query"))


@query(O.with_(O.LOG) + " SELECT query, count(*) AS count FROM log WHERE results_count > 0 GROUP BY query ORDER BY count DESC, query DESC LIMIT 20")
def popular_queries(spark, sf_dir):
    return analytics.popular_queries(_log(spark, sf_dir))


@query(O.with_(O.LOG) + " SELECT product_id, count(*) AS clicks FROM clicks GROUP BY 1 ORDER BY clicks DESC, product_id DESC LIMIT 20")
def popular_products(spark, sf_dir):
    return analytics.popular_products(_clicks(spark, sf_dir))


@query(O.with_(O.LOG) + " SELECT trim(lower(query)) AS query, count(*) AS clicks FROM clicks GROUP BY 1 ORDER BY clicks DESC, 1 DESC LIMIT 10")
def converting_queries(spark, sf_dir):
    return analytics.converting_queries(_clicks(spark, sf_dir))


@query(O.with_(O.LOG) + " SELECT CAST(d AS DATE) AS day, (SELECT count(*) FROM log WHERE CAST(ts AS DATE) = CAST(d AS DATE)) AS count FROM generate_series(DATE '2024-01-14', DATE '2024-02-02', INTERVAL 1 DAY) g(d)")
def queries_by_day_dense(spark, sf_dir):
    return analytics.dense_days(analytics.searches(_log(spark, sf_dir)), date(2024, 2, 2), 20)


@query(O.with_(O.LOG) + " SELECT date_trunc('hour', ts) AS bucket, count(*) AS count FROM clicks GROUP BY 1")
def clicks_by_hour(spark, sf_dir):
    return analytics.per_bucket(_clicks(spark, sf_dir), "hour").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "count")


@query(O.with_(O.LOG) + " SELECT round_even(avg(took_ms), 2) AS avg_ms, count(*) AS n FROM (SELECT took_ms FROM log ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def avg_response_last_1000(spark, sf_dir):
    return analytics.mean_recent(_log(spark, sf_dir), "ts", "event_id")


@query(O.with_(O.LOG) + " SELECT (SELECT count(*) FROM log) AS total_queries, (SELECT count(*) FROM clicks) AS total_clicks")
def analytics_totals(spark, sf_dir):
    return analytics.report(_log(spark, sf_dir), _clicks(spark, sf_dir), DAY, 0)["totals"]


@query(O.with_(O.LOG) + " SELECT (SELECT count(*) FROM log WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-20') AS total_queries, (SELECT count(*) FROM clicks WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-20') AS total_clicks")
def analytics_week(spark, sf_dir):
    return analytics.report(_log(spark, sf_dir), _clicks(spark, sf_dir), DAY, 7)["totals"]


@query("SELECT event_type, sum(n)::BIGINT AS count FROM (SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events WHERE event_id % 2 = 1 GROUP BY 1) GROUP BY 1")
def merge_counters(spark, sf_dir):
    of = lambda k: table(spark, sf_dir, "events").where(f"event_id % 2 = {k}").groupBy("event_type").agg(F.count("*").alias("count"))
    return analytics.merge_counters(of(0), of(1), "event_type")


@query("SELECT user_id, CASE WHEN s > 0 THEN CAST(floor(100.0::DOUBLE * c / s + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS ctr FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'view') AS s FROM events GROUP BY 1)")
def ctr(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "view").alias("s"))
    return per.select("user_id", analytics.ctr(F.col("c"), F.col("s")).alias("ctr"))


# Billing and feeds: customers stand for users, orders for projects.

_PROJECTS = "users AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS email, CASE WHEN c_custkey = 0 THEN 'admin' ELSE 'user' END AS role FROM customer), projects AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS name, CAST(o_custkey AS VARCHAR) AS user_id, CASE WHEN o_orderstatus = 'P' THEN 'suspended' ELSE 'active' END AS status, CAST(o_orderdate AS DATE) AS paid_until, o_orderkey % 4 = 0 AS reminded, o_orderdate AS created_at FROM orders)"
TODAY = date(1998, 6, 1)


def _projects(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_custkey").cast("string").alias("user_id"), F.when(F.col("o_orderstatus") == "P", "suspended").otherwise("active").alias("status"),
        F.to_date("o_orderdate").alias("paid_until"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("expiry_reminder_sent_at"), F.col("o_orderdate").alias("created_at"),
    )


def _users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("email"), F.when(F.col("c_custkey") == 0, "admin").otherwise("user").alias("role"))


@query(O.with_(_PROJECTS) + " SELECT p.id, p.name, user_id, email, paid_until, CAST(date_diff('day', DATE '1998-06-01', paid_until) AS INT) AS days_left FROM projects p JOIN users u ON u.id = user_id WHERE status = 'active' AND paid_until BETWEEN DATE '1998-06-01' AND DATE '1998-06-08' AND NOT reminded")
def projects_expiring(spark, sf_dir):
    return analytics.expiring(_projects(spark, sf_dir), _users(spark, sf_dir), TODAY)


@query(O.with_(_PROJECTS) + " SELECT id, paid_until FROM projects WHERE status = 'active' AND paid_until < DATE '1996-01-01'")
def projects_expired(spark, sf_dir):
    return analytics.expired(_projects(spark, sf_dir), date(1996, 1, 1)).select("id", "paid_until")


@query(O.with_(_PROJECTS) + " SELECT '0' AS staff_id, p.id AS project_id, 'expires in ' || date_diff('day', DATE '1998-06-01', paid_until) || ' days' AS message FROM projects p WHERE status = 'active' AND paid_until BETWEEN DATE '1998-06-01' AND DATE '1998-06-08' AND NOT reminded")
def billing_reminders(spark, sf_dir):
    users = _users(spark, sf_dir)
    return analytics.reminders(analytics.expiring(_projects(spark, sf_dir), users, TODAY), users)


@query(O.with_(_PROJECTS) + " SELECT p.id, email, 'key-' || k.id AS key FROM projects p JOIN users u ON u.id = user_id LEFT JOIN (SELECT id FROM projects WHERE CAST(id AS BIGINT) % 2 = 0) k ON k.id = p.id")
def projects_admin_list(spark, sf_dir):
    projects = _projects(spark, sf_dir)
    keys = projects.where(F.col("id").cast("long") % 2 == 0).select(F.col("id").alias("project_id"), F.concat(F.lit("key-"), "id").alias("key"))
    return analytics.admin_list(projects, _users(spark, sf_dir), keys).select("id", "email", "key")


_RUN = "CASE c_custkey % 5 WHEN 0 THEN '2024-01-01T08:00:00Z' WHEN 1 THEN '2024-01-01T08:00:01Z' WHEN 2 THEN 'nonsense' WHEN 3 THEN '2023-06-01T00:00:00Z' END"


@query(f"WITH r AS (SELECT c_custkey AS id, {_RUN} AS t FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS project_id, c_name AS feed_url FROM customer JOIN r ON id = c_custkey WHERE c_custkey % 3 <> 0 AND (t IS NULL OR coalesce(TRY_CAST(replace(t, 'Z', '') AS TIMESTAMP), TIMESTAMP '1970-01-01') <= TIMESTAMP '2024-01-01 08:00:00')")
def stale_feeds(spark, sf_dir):
    customers, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    projects = customers.select(k.cast("string").alias("project_id"), F.when(k % 6 == 0, "").when(k % 3 != 0, F.col("c_name")).alias("feed_url"))
    last = customers.where(k % 5 < 4).select(k.cast("string").alias("project_id"), F.expr(_RUN).alias("last_update"), F.lit(2).alias("ts"))
    first = last.select("project_id", F.lit("2020-01-01T00:00:00Z").alias("last_update"), F.lit(1).alias("ts"))
    return analytics.stale_feeds(projects, last.union(first), "2024-01-01 12:00:00")


# Feeds and deltas.

_DELTA = "delta AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_retailprice * 0.5 END AS price, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 10 = 0 END AS BOOLEAN) AS in_stock, CASE WHEN p_partkey % 6 = 0 THEN 7 END AS quantity FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'new', 1.0, true, 1)"


def _delta(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").where(k % 3 == 0)
    own = rows.select(k.cast("string").alias("id"), F.when(k % 2 == 0, F.col("p_retailprice")).otherwise(F.col("p_retailprice") * 0.5).alias("price"), F.lit(None).cast("double").alias("old_price"), F.when(k % 5 == 0, k % 10 == 0).alias("in_stock"), F.when(k % 6 == 0, 7).alias("quantity"))
    return own.union(spark.createDataFrame([("new", 1.0, None, True, 1)], "id string, price double, old_price double, in_stock boolean, quantity int"))


@query(
    O.with_(O.CATALOG, _DELTA)
    + """ SELECT c.id, coalesce(d.price, c.price) AS price, coalesce(d.in_stock, c.in_stock) AS in_stock, d.quantity, coalesce((d.price IS NOT NULL AND d.price <> c.price) OR (d.in_stock IS NOT NULL AND d.in_stock <> c.in_stock) OR d.quantity IS NOT NULL, false) AS changed,
  CASE WHEN old_price > coalesce(d.price, c.price) THEN round_even((1 - coalesce(d.price, c.price) / old_price) * 100, 0)::INT END AS discount_percent FROM catalog c LEFT JOIN delta d USING (id)"""
)
def delta_merge(spark, sf_dir):
    merged = index.merge_delta(C.from_parts(spark, sf_dir), _delta(spark, sf_dir))
    return merged.select("id", "price", "in_stock", "quantity", "changed", "discount_percent")


#: The catalog after the delta; what stands before it is named ``before``.
_AFTER = (O.CATALOG.replace("catalog AS", "before AS", 1), _DELTA, "catalog AS (SELECT b.* REPLACE (coalesce(d.in_stock, b.in_stock) AS in_stock), b.in_stock AS was FROM before b LEFT JOIN delta d USING (id))")


@query(O.with_(*_AFTER, _TOKEN_SET) + f" SELECT token, product_id, CASE WHEN was AND NOT in_stock THEN whole * 0.5 ELSE score END AS score FROM ({_PLACED_POSTINGS.replace(' AS score FROM tk', ' AS score, in_stock, was FROM tk')}) JOIN (SELECT token AS t, product_id AS p, score AS whole FROM ({_PLACED_POSTINGS.replace('CASE WHEN in_stock', 'CASE WHEN true')})) ON t = token AND p = product_id")
def delta_restock(spark, sf_dir):
    cat = C.from_parts(spark, sf_dir)
    return index.restocked(index.placed_postings(cat), cat, index.merge_delta(cat, _delta(spark, sf_dir)), index.placed_postings).drop("project_id")


@query(O.with_(*_AFTER, _TOKEN_SET) + " " + _PLACED_POSTINGS)
def index_after_delta(spark, sf_dir):
    shop = new_shop(spark, "rich")
    shop.replace(C.from_parts(spark, sf_dir), C.DEMO)
    shop.delta(_delta(spark, sf_dir), C.DEMO)
    return shop.index().postings.drop("project_id")


@query(O.with_(O.CATALOG, O.POSTINGS) + " SELECT token, product_id, score FROM postings WHERE CAST(product_id AS BIGINT) % 10 <> 0 AND CAST(product_id AS BIGINT) % 7 <> 3 UNION ALL SELECT 'changed', id, 3.0 FROM catalog WHERE CAST(id AS BIGINT) % 10 = 0 AND CAST(id AS BIGINT) % 7 <> 3")
def index_compacted(spark, sf_dir):
    cat, shop, k = C.from_parts(spark, sf_dir), new_shop(spark, "plain"), F.col("id").cast("long")
    shop.replace(cat, C.DEMO)
    gone = [F.lit(None).cast(t).alias(c) for c, t in cat.dtypes if c not in ("project_id", "id", "name")]
    shop.upsert(cat.where(k % 10 == 0).select("project_id", "id", F.lit("changed").alias("name"), *gone))
    shop.delete(cat.where(k % 7 == 3))
    shop.compact()
    return shop.index().postings.drop("project_id")


@query(O.with_(*_AFTER) + " SELECT 1 AS version, id, in_stock FROM before UNION ALL SELECT 2, id, in_stock FROM catalog")
def catalog_as_of(spark, sf_dir):
    shop = new_shop(spark, "plain")
    shop.replace(C.from_parts(spark, sf_dir), C.DEMO)
    shop.delta(_delta(spark, sf_dir), C.DEMO)
    of = lambda n: shop.catalog(shop.version(n)).select(F.lit(n).alias("version"), "id", "in_stock")
    return of(1).unionByName(of(2))


@query(O.with_(O.CATALOG) + " SELECT id, name FROM catalog WHERE CAST(id AS BIGINT) % 3 <> 0")
def delta_anti_delete(spark, sf_dir):
    cat = C.from_parts(spark, sf_dir)
    return index.delete(cat, cat.where(F.col("id").cast("long") % 3 == 0)).select("id", "name")


@query(O.with_(O.CATALOG, O.POSTINGS) + " SELECT token, product_id, score FROM postings WHERE CAST(product_id AS BIGINT) % 10 <> 0 UNION ALL SELECT 'changed', id, 3.0 FROM catalog WHERE CAST(id AS BIGINT) % 10 = 0")
def index_upsert(spark, sf_dir):
    cat = C.from_parts(spark, sf_dir)
    gone = [F.lit(None).cast(t).alias(c) for c, t in cat.dtypes if c not in ("project_id", "id", "name")]
    changed = cat.where(F.col("id").cast("long") % 10 == 0).select("project_id", "id", F.lit("changed").alias("name"), *gone)
    return index.upsert(index.postings(cat), changed).drop("project_id")


_RAW = "SELECT CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE CAST(p_partkey AS STRING) END AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'u' END AS url, CASE p_partkey % 3 WHEN 0 THEN 'x1.2.3' WHEN 1 THEN '5,5' ELSE '' END AS price, p_partkey AS k FROM part"


@query(f"SELECT id, concat_ws('|', CASE WHEN trim(id) = '' THEN 'missing id' END, CASE WHEN name IS NULL THEN 'missing name' END, CASE WHEN url = '' THEN 'missing url' END, CASE WHEN price = 'x1.2.3' THEN 'invalid price' END) AS errors FROM ({_RAW})")
def validate_products(spark, sf_dir):
    raw = spark.sql(_RAW.replace("FROM part", "FROM {parts}"), parts=table(spark, sf_dir, "part"))
    return feeds.problems(raw.drop("k")).select("id", F.array_join("errors", "|").alias("errors"))


_CHANGES = "SELECT CAST(p_partkey AS STRING) AS id, CASE p_partkey % 4 WHEN 0 THEN '1 299,90' WHEN 1 THEN 'bad' WHEN 2 THEN CAST(p_size AS STRING) END AS price, CASE WHEN p_partkey % 3 = 0 THEN concat(p_size, ',5') END AS oldprice, CASE p_partkey % 5 WHEN 0 THEN 'В наличии' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'available' END AS available, CASE p_partkey % 6 WHEN 0 THEN '3' WHEN 1 THEN 'x' END AS quantity FROM part"


@query(f"SELECT id, TRY_CAST(replace(replace(price, ',', '.'), ' ', '') AS DOUBLE) AS price, TRY_CAST(replace(oldprice, ',', '.') AS DOUBLE) AS old_price, lower(available) IN ({', '.join(map(O.text, W.STOCK_WORDS))}) AS in_stock, TRY_CAST(quantity AS INTEGER) AS quantity FROM ({_CHANGES})")
def delta_parse(spark, sf_dir):
    return feeds.delta(spark.sql(_CHANGES.replace("FROM part", "FROM {parts}"), parts=table(spark, sf_dir, "part")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' & co' AS name, p_retailprice AS price, p_partkey % 7 <> 0 AS in_stock, category, p_brand AS brand, '{\"size\":\"' || p_size || '\"}' AS params FROM part JOIN (SELECT length(p_type) AS n, min(lower(p_type)) AS category FROM part GROUP BY 1) ON n = length(p_type)")
def feed_yml(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    attrs = F.concat(F.lit('<offer id="'), F.col("p_partkey").cast("string"), F.lit('" available="'), F.when(F.col("p_partkey") % 7 == 0, "false").otherwise("true"), F.lit('">'))
    xml = F.concat(attrs, F.lit("<name>"), "p_name", F.lit(" &amp;amp; co</name><vendor>"), "p_brand", F.lit("</vendor><price>"), F.col("p_retailprice").cast("string"), F.lit("</price><categoryId>"), F.length("p_type").cast("string"), F.lit('</categoryId><param name="size">'), F.col("p_size").cast("string"), F.lit("</param></offer>"))
    parsed = rows.select(F.from_xml(xml, feeds.OFFER.simpleString(), {"rowTag": "offer", "attributePrefix": "_", "valueTag": "_VALUE"}).alias("o")).select("o.*")
    categories = rows.select(F.length("p_type").cast("string").alias("id"), F.lower("p_type").alias("name")).groupBy("id").agg(F.min("name").alias("name"))
    return feeds.offers(parsed, categories).select("id", "name", "price", "in_stock", "category", "brand", F.to_json("params").alias("params"))


@query(SQL["feed_yml"])
def feed_yml_split(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    kind = F.length("p_type").cast("string")
    offer = F.concat(
        F.lit('<offer id="'), F.col("p_partkey").cast("string"), F.lit('" available="'), (F.col("p_partkey") % 7 != 0).cast("string"), F.lit('">'),
        tag("name", F.concat("p_name", F.lit(" &amp;amp; co"))), tag("vendor", F.col("p_brand")), tag("price", F.col("p_retailprice").cast("string")), tag("categoryId", kind),
        F.lit('<param name="size">'), F.col("p_size").cast("string"), F.lit("</param></offer>"),
    )
    named = rows.groupBy(kind.alias("id")).agg(F.min(F.lower("p_type")).alias("name"))
    lines = named.select(F.concat(F.lit('<category id="'), "id", F.lit('">'), "name", F.lit("</category>")).alias("value")).unionByName(rows.select(offer.alias("value")))
    path = counters.shared_folder(spark, "feed")
    lines.write.text(path)
    return feeds.read_yml_split(spark, path).select("id", "name", "price", "in_stock", "category", "brand", F.to_json("params").alias("params"))


# Ranking, spelling, vectors.


@query(
    O.with_(*O.hits(BASIC))
    + """, pop AS (SELECT CAST(l_partkey AS VARCHAR) AS id, count(*)::DOUBLE AS popularity FROM lineitem GROUP BY 1),
r AS (SELECT h.query_id, c.id, c.name, c.price, coalesce(popularity, 0) AS popularity, c.in_stock, tokens, h.score AS base, CASE WHEN old_price > price THEN round_even((1 - price / old_price) * 100, 0) END AS dp FROM hits h JOIN catalog c ON c.id = product_id JOIN asked USING (query_id) LEFT JOIN pop ON pop.id = c.id WHERE h.stage = 0),
m AS (SELECT *, max(price) OVER (PARTITION BY query_id) AS mp, max(popularity) OVER (PARTITION BY query_id) AS mq, list_filter(list_transform(tokens, lambda t: instr(lower(name), t)), lambda p: p > 0) AS ps FROM r),
f AS (SELECT query_id, id, round_even(((base * 0.5::DOUBLE + (CASE WHEN len(ps) > 0 THEN 1.0::DOUBLE - (list_min(ps) - 1)::DOUBLE / length(name) ELSE 0 END) * 0.3::DOUBLE + (CASE WHEN contains(lower(name), array_to_string(tokens, ' ')) THEN 1.0::DOUBLE ELSE 0 END) * 0.2::DOUBLE) * 0.4::DOUBLE
  + popularity / (CASE WHEN mq <> 0 THEN mq ELSE 1 END) * 0.2::DOUBLE + (coalesce(dp / 100, 0) * 0.6::DOUBLE + (1 - price / mp) * 0.4::DOUBLE) * 0.2::DOUBLE) * (CASE WHEN in_stock THEN 1.0::DOUBLE ELSE 0.3 END), 6) AS final FROM m)
SELECT * FROM f"""
)
def rank_multifactor(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    asks = search.prepared(asked(spark, BASIC))
    popular = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("id")).agg(F.count("*").cast("double").alias("popularity"))
    found = search.token_hits(asks, idx.postings).select("query_id", F.col("product_id").alias("id"), F.col("score").alias("base"))
    rows = found.join(C.with_discount(cat), "id").join(popular, "id", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0.0))).join(asks.select("query_id", "tokens"), "query_id")
    return ranking.ranked(rows).select("query_id", "id", F.bround("final", 6).alias("final"))


@query("SELECT p_type AS value, count(*) AS count FROM part WHERE p_retailprice >= 950 AND contains(lower(p_type), 'm') AND p_partkey % 7 <> 0 GROUP BY 1")
def filter_contains(spark, sf_dir):
    rows = ranking.filtered(C.from_parts(spark, sf_dir), {"price_min": 950, "in_stock": True, "category": "M"})
    return ranking.top_counts(rows.withColumn("position", F.col("id")), "category")


MISSPELT = ("widgit", "rng", "anvill", "zzzzzz", "blue", "gizno", "platte")
_WORDS = "dict AS (SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE length(word) >= 3 GROUP BY word)"
_CORRECTED = f"m AS (SELECT unnest({O.strings(MISSPELT)}) AS word), cand AS (SELECT m.word, d.word AS c, levenshtein(m.word, d.word) AS dist, freq FROM m, dict d WHERE levenshtein(m.word, d.word) <= 2), best AS (SELECT word, arg_min(c, {{'s': -(freq / (dist + 1)), 'd': dist, 'c': c}}) AS c, arg_min(dist, {{'s': -(freq / (dist + 1)), 'd': dist, 'c': c}}) AS dist FROM cand GROUP BY word)"


def _words(spark, sf_dir):
    return spell.dictionary(table(spark, sf_dir, "part"), "p_name")


@query(O.with_(_WORDS, _CORRECTED) + " SELECT m.word, coalesce(c, m.word) AS correction, round_even(coalesce(1.0::DOUBLE - dist / 3.0::DOUBLE, 0.5), 6) AS confidence FROM m LEFT JOIN best USING (word)")
def spell_correct(spark, sf_dir):
    words = _words(spark, sf_dir)
    out = spell.corrections(spark.createDataFrame([(w,) for w in MISSPELT], "word string"), spell.deletes(words), words)
    return out.withColumn("confidence", F.bround("confidence", 6))


@query(O.with_(_WORDS) + " SELECT word, freq FROM dict")
def spell_dictionary(spark, sf_dir):
    return _words(spark, sf_dir)


_CUT = "SELECT DISTINCT word, left({0}, i - 1) || substring({0}, i + 1) AS del FROM {1}, range(1, 20) r(i) WHERE i <= length({0})"


@query(O.with_(_WORDS) + f", d1 AS ({_CUT.format('word', 'dict').replace('DISTINCT word', 'DISTINCT word')}), d2 AS ({_CUT.format('del', 'd1')}) SELECT word, del FROM (SELECT word, word AS del FROM dict UNION SELECT word, del FROM d1 UNION SELECT word, del FROM d2) WHERE del <> ''")
def symspell_deletes(spark, sf_dir):
    return spell.deletes(_words(spark, sf_dir)).select("word", "del")


@query("SELECT * FROM (VALUES (0, 'red widget', 0.666667, true), (1, 'blue gear', 1.0, false)) v(query_id, corrected, confidence, was_corrected)")
def spell_check(spark, sf_dir):
    asks = spark.createDataFrame([(0, "RED widgitt"), (1, "blue gear")], "query_id int, q string")
    out = spell.check(asks, _words(spark, sf_dir))
    return out.select("query_id", "corrected", F.bround("confidence", 6).cast("decimal(9,6)").alias("confidence"), "was_corrected")


def _collection(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("n"), (F.col("vec_id") % 100).cast("string")).alias("payload"))


def _probe(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1))"


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, round({_COS}, 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, sf_dir):
    return vectors.top_k(_collection(spark, sf_dir), _probe(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, round({_COS}, 6) AS score FROM embeddings WHERE label = 3 AND vec_id % 100 BETWEEN 10 AND 80 ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    must = {"must": [{"key": "label", "match": {"value": 3}}, {"key": "n", "range": {"gte": 10, "lte": 80}}]}
    return vectors.top_k(_collection(spark, sf_dir), _probe(spark, sf_dir), 10, must).withColumn("score", F.round("score", 6))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, round(sqrt(greatest(2 - 2 * {_COS}, 0)), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 10")
def vector_approximate(spark, sf_dir):
    return vectors.approximate_top_k(_collection(spark, sf_dir), _probe(spark, sf_dir), 10).withColumn("distance", F.round("distance", 6))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, vec_id >= 100 AS old FROM embeddings WHERE vec_id % 5 <> 0")
def vector_upsert_delete(spark, sf_dir):
    points = _collection(spark, sf_dir)
    n = F.col("id").cast("long")
    fresh = points.where(n < 100).withColumn("payload", F.create_map(F.lit("new"), F.lit("1")))
    return vectors.delete(vectors.upsert(points, fresh), points.where(n % 5 == 0)).select("id", (~F.map_contains_key("payload", "new")).alias("old"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 1.0::DOUBLE AS norm FROM part")
def embed_products(spark, sf_dir):
    cat = C.from_parts(spark, sf_dir).withColumn("search_text", F.lit(""))
    return vectors.embed(cat, X.embedding_text()).select("id", F.round(vectors.norm(F.col("vector")), 4).alias("norm"))


@query("SELECT 1 AS run, count(DISTINCT p_name || ' ' || p_brand || ' ' || p_type) AS embedded, count(*) AS products FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 2, (SELECT count(DISTINCT p_name || ' ' || p_brand || ' ' || p_type) FROM part) - (SELECT count(DISTINCT p_name || ' ' || p_brand || ' ' || p_type) FROM part WHERE p_partkey % 2 = 0), count(*) FROM part UNION ALL SELECT 3, 0, count(*) FROM part")
def embedding_cache(spark, sf_dir):
    cat, store = C.from_parts(spark, sf_dir).withColumn("search_text", F.lit("")), Snapshots(spark, counters.shared_folder(spark, "texts"))
    rows = []
    for run, some in enumerate((cat.where(F.col("id").cast("long") % 2 == 0), cat, cat), 1):
        out, n = vectors.embed_stored(some, X.embedding_text(), store)
        rows.append(out.agg(F.count("*").alias("products")).select(F.lit(run).alias("run"), F.lit(n).cast("long").alias("embedded"), "products"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query()
def vector_cells(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = counters.shared_folder(spark, "cells")
    cells.write(points, path, cells.fit(points))
    asks = [(r["id"], r["vector"]) for r in points.where("id % 50 = 0").collect()]
    return cells.search(spark, path, asks, 10).withColumn("score", F.round("score", 6))


_TWO = "kw AS (SELECT 0 AS query_id, CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position FROM part QUALIFY position <= 100), ve AS (SELECT 0 AS query_id, CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY p_size, p_partkey) AS position FROM part QUALIFY position <= 100), fused AS (SELECT query_id, id, rrf, row_number() OVER (ORDER BY rrf DESC, late, id) AS position FROM (SELECT coalesce(kw.query_id, ve.query_id) AS query_id, coalesce(kw.id, ve.id) AS id, coalesce(1.0::DOUBLE / (60 + kw.position), 0) + coalesce(1.0::DOUBLE / (60 + ve.position), 0) AS rrf, kw.id IS NULL AS late FROM kw FULL JOIN ve ON kw.id = ve.id))"


def _two(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit(0).alias("query_id"), F.col("p_partkey").cast("string").alias("id"), "p_partkey", "p_size", "p_retailprice")
    lists = []
    for order in ((F.desc("p_retailprice"), F.asc("p_partkey")), (F.asc("p_size"), F.asc("p_partkey"))):
        lists.append(p.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("position <= 100").select("query_id", "id", "position"))
    return lists


@query(O.with_(_TWO) + " SELECT query_id, id, round(rrf, 9) AS rrf, position FROM fused")
def rrf_merge(spark, sf_dir):
    return vectors.fuse(*_two(spark, sf_dir)).withColumn("rrf", F.round("rrf", 9))


_RERANKED = "rr AS (SELECT f.query_id, f.id, f.position AS before, len(list_intersect(['red', 'ring', 'economy'], list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')))) / 3.0::DOUBLE + 1.0::DOUBLE / f.position AS score FROM fused f JOIN part ON CAST(p_partkey AS VARCHAR) = f.id WHERE f.position <= 20)"


@query(O.with_(_TWO, _RERANKED) + " SELECT query_id, id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, before) AS position FROM rr")
def rerank_overlap(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    asks = spark.createDataFrame([(0, "Red ring economy")], "query_id int, q string")
    return vectors.rerank(vectors.fuse(*_two(spark, sf_dir)), asks, texts).withColumn("score", F.round("score", 6))


@query()
def hybrid_search(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return hybrid.hybrid_search(spark, "red ringg", _words(spark, sf_dir), idx, cat)


_RICH_RANKED = """m AS (SELECT *, max(price) OVER (PARTITION BY query_id) AS mp, max(popularity) OVER (PARTITION BY query_id) AS mq, list_filter(list_transform(tokens, lambda t: instr(lower(name), t)), lambda p: p > 0) AS ps FROM r),
f AS (SELECT *, ((base * 0.5::DOUBLE + (CASE WHEN len(ps) > 0 THEN 1.0::DOUBLE - (list_min(ps) - 1)::DOUBLE / length(name) ELSE 0 END) * 0.3::DOUBLE + (CASE WHEN contains(lower(name), array_to_string(tokens, ' ')) THEN 1.0::DOUBLE ELSE 0 END) * 0.2::DOUBLE) * 0.4::DOUBLE
  + popularity / (CASE WHEN mq <> 0 THEN mq ELSE 1 END) * 0.2::DOUBLE + (coalesce(dp / 100, 0) * 0.6::DOUBLE + (1 - price / mp) * 0.4::DOUBLE) * 0.2::DOUBLE) AS raw FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round_even(raw, 9) DESC, base DESC, id DESC) AS position, count(*) OVER (PARTITION BY query_id) AS total FROM f)"""
_RICH_ASKED = "asked AS (SELECT query_id, list_filter(regexp_split_to_array(n, '[\\s\\-]+'), lambda w: length(w) > 1) AS tokens FROM (SELECT query_id, " + O.normalize("q") + " AS n FROM (VALUES " + ", ".join(f"({k}, {O.text(q)})" for k, (q, _) in enumerate(BASIC)) + ") v(query_id, q)))"


@query(
    O.with_(
        O.CATALOG,
        _TOKEN_SET,
        f"placed AS ({_PLACED_POSTINGS})",
        _RICH_ASKED,
        "base AS (SELECT query_id, product_id AS id, round_even(sum(score), 9) AS base FROM (SELECT query_id, unnest(tokens) AS token FROM asked) JOIN placed USING (token) GROUP BY ALL)",
        "pop AS (SELECT CAST(l_partkey AS VARCHAR) AS id, count(*)::DOUBLE AS popularity FROM lineitem GROUP BY 1)",
        "r AS (SELECT query_id, c.id, name, price, category, brand, in_stock, coalesce(popularity, 0) AS popularity, tokens, base, CASE WHEN old_price > price THEN round_even((1 - price / old_price) * 100, 0) END AS dp FROM base JOIN catalog c USING (id) JOIN asked USING (query_id) LEFT JOIN pop USING (id) WHERE in_stock)",
        _RICH_RANKED,
    )
    + " SELECT query_id, position, id, name, round_even(raw, 6) AS final, total, price, category, brand, in_stock, regexp_replace(name, '(red)', '<em>\\1</em>', 'gi') AS highlighted_name FROM g WHERE position <= 20"
)
def rich_search(spark, sf_dir):
    cat = C.from_parts(spark, sf_dir)
    popular = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("id")).agg(F.count("*").cast("double").alias("popularity"))
    page = rich.rich_search(asked(spark, BASIC), rich.build(cat), cat, popular, {"in_stock": True})
    return rich.highlighted(page, ["red"]).drop("tokens")


_PAD = "'__' || {0} || '__'"


@query(
    O.with_(O.CATALOG, O.POSTINGS)
    + f", tk AS (SELECT unnest(['widgetz', 'anvi']) AS token), ix AS (SELECT DISTINCT token AS match FROM postings), j AS (SELECT token, match, len(list_intersect({O.ngrams(_PAD.format('token'))}, {O.ngrams(_PAD.format('match'))}))::DOUBLE AS common, len(list_distinct({O.ngrams(_PAD.format('token'))})) AS a, len(list_distinct({O.ngrams(_PAD.format('match'))})) AS b FROM tk, ix), s AS (SELECT token, match, CASE WHEN token = match THEN 1.0 ELSE common / (a + b - common) END AS similarity FROM j WHERE common > 0) SELECT product_id, round_even(sum(score * similarity) * 0.8::DOUBLE, 9) AS score FROM s JOIN postings p ON p.token = s.match WHERE similarity > 0.5 GROUP BY product_id"
)
def ngram_padded(spark, sf_dir):
    posted = index.postings(C.from_parts(spark, sf_dir))
    idx = search.Index(posted, index.ngram_index(posted, X.padded_ngrams))
    asks = search.literal_rows(spark, [{"query_id": 0, "project_id": "demo", "tokens": ["widgetz", "anvi"]}], "query_id int, project_id string, tokens array<string>")
    return search.ngram_hits(asks, idx, rich.KEPT, rich.SIMILAR, X.padded_ngrams, few=True).select("product_id", "score")


@query("SELECT query_id, pos::INT AS pos, CASE token WHEN 'red' THEN 'red|crimson|scarlet' WHEN 'gear' THEN 'gear|cog' ELSE token END AS words FROM (SELECT p_partkey AS query_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part))")
def synonym_lists(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.posexplode(F.split("p_name", " ")).alias("pos", "token"))
    known = spark.createDataFrame([("red", ["crimson", "red", "scarlet"]), ("gear", ["cog"])], "word string, synonyms array<string>")
    return search.synonym_lists(tokens, known).select("query_id", "pos", F.array_join("words", "|").alias("words"))


@query(O.with_(_PROJECTS) + " SELECT CASE WHEN status = 'active' AND paid_until < DATE '1998-06-01' THEN 'suspended' ELSE status END AS status, count(*) AS n FROM projects GROUP BY 1")
def projects_suspended(spark, sf_dir):
    return analytics.suspended(_projects(spark, sf_dir), TODAY).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT sum(s)::BIGINT AS searches, sum(c)::BIGINT AS clicks, 0::BIGINT AS products, CAST(floor(100.0::DOUBLE * sum(c) / sum(s) + 0.5::DOUBLE) AS BIGINT) AS ctr FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'view') AS s FROM events GROUP BY 1)")
def across_projects(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("project_id")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("searches"), F.lit(0).cast("long").alias("products"))
    return analytics.across_projects(per)


# What is shown.


@query(
    O.search([("red ring", 10_000)]).replace(f"SELECT {O.ROW}", "SELECT query_id, category, place AS position, id, in_category FROM (SELECT query_id, c.category, row_number() OVER (PARTITION BY query_id, c.category ORDER BY position) AS place, c.id, count(*) OVER (PARTITION BY query_id, c.category) AS in_category")
    + ") WHERE place <= 8"
)
def group_preview_top8(spark, sf_dir):
    cat, idx = built(spark, sf_dir)
    return analytics.grouped_preview(search.search(asked(spark, [("red ring", 10_000)]), idx, cat))


@query(O.with_(O.CATALOG) + " SELECT count(DISTINCT category) AS categories, count(*) FILTER (WHERE in_stock) AS in_stock FROM (SELECT * FROM catalog ORDER BY id LIMIT 500)")
def catalog_summary(spark, sf_dir):
    return analytics.catalog_summary(C.from_parts(spark, sf_dir))


# Operators that the queries above do not go through.


@query(O.with_(_PROJECTS) + ", keys AS (SELECT 'key-' || id AS key, id AS project_id FROM projects WHERE CAST(id AS BIGINT) % 2 = 0) SELECT key, project_id, name, user_id FROM keys JOIN projects ON id = project_id")
def project_by_key(spark, sf_dir):
    projects = _projects(spark, sf_dir)
    keys = projects.where(F.col("id").cast("long") % 2 == 0).select(F.concat(F.lit("key-"), "id").alias("key"), F.col("id").alias("project_id"))
    return analytics.projects_by_key(keys, projects).select("key", "project_id", "name", "user_id")


@query(O.with_(_PROJECTS) + " SELECT arg_min(id, (created_at, id)) AS id FROM (SELECT c_custkey::VARCHAR AS id, min(o_orderdate) AS created_at FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey <> 0 GROUP BY 1)")
def first_admin(spark, sf_dir):
    made = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.min("o_orderdate").alias("created_at"))
    return analytics.first_user(_users(spark, sf_dir).where("id <> '0'").join(made, "id"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS unread FROM events GROUP BY 1")
def notifications_unread(spark, sf_dir):
    return analytics.unread(table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "view").alias("is_read")))


@query("SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('hour', ts) > TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 168 HOUR")
def counters_retained(spark, sf_dir):
    hour = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:00:00"))
    hourly = table(spark, sf_dir, "events").groupBy(hour.alias("bucket")).agg(F.count("*").alias("n"))
    return analytics.retained(hourly, F.to_timestamp_ntz(F.lit("2024-01-25 12:00:00")), "hour")


_PLACED = "SELECT 0 AS query_id, CAST(p_partkey AS VARCHAR) AS id, p_type AS category, p_partkey % 7 <> 0 AS in_stock, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position FROM part"


def _placed(spark, sf_dir):
    rows = C.from_parts(spark, sf_dir).select(F.lit(0).alias("query_id"), "id", "category", "in_stock", "price")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("price"), F.col("id").cast("long")))).drop("price")


@query(f"SELECT id, position, shown FROM (SELECT *, row_number() OVER (ORDER BY NOT in_stock, position) AS shown FROM ({_PLACED})) WHERE shown <= 20")
def shown_stock_first(spark, sf_dir):
    return analytics.stock_first(_placed(spark, sf_dir)).select("id", "position", "shown")


@query(f"SELECT id, place FROM (SELECT *, row_number() OVER (ORDER BY position) AS place FROM ({_PLACED}) WHERE category = 'ECONOMY') WHERE place > 20 AND place <= 40")
def category_page(spark, sf_dir):
    return analytics.category_page(_placed(spark, sf_dir), "ECONOMY", 1).select("id", "place")


@query("SELECT 'demo' AS project_id, count(*) AS products, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS in_stock, count(DISTINCT p_type) AS categories FROM part")
def catalog_overview(spark, sf_dir):
    return requests.overview(C.from_parts(spark, sf_dir))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 2 = 1")
def index_clear(spark, sf_dir):
    cat = C.from_parts(spark, sf_dir).withColumn("project_id", F.when(F.col("id").cast("long") % 2 == 0, "even").otherwise("odd"))
    return index.clear(cat, "even").select("id")


@query(f"SELECT p_partkey AS id, array_to_string(list_concat([n], {O.variants('n')}), '|') AS variants FROM (SELECT p_partkey, {O.normalize('p_name')} AS n FROM part)")
def query_variants(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.query_variants("p_name"), "|").alias("variants"))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, round({_COS}, 6) AS score FROM embeddings WHERE label % 2 = 0 AND vec_id % 100 BETWEEN 20 AND 70 ORDER BY score DESC, id LIMIT 10")
def vector_request_filter(spark, sf_dir):
    n = F.col("vec_id") % 100
    payload = F.create_map(F.lit("in_stock"), (F.col("label") % 2 == 0).cast("string"), F.lit("price"), n.cast("string"))
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), payload.alias("payload"))
    return vectors.top_k(points, _probe(spark, sf_dir), 10, vectors.vector_filter(20, 70, True)).withColumn("score", F.round("score", 6))


# Streams, run to the end of what is there.


@query("SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS count FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    stream = counters.counts(counters.read_events(spark, f"{sf_dir}/events.parquet"), "1 day", "event_type")
    return counters.to_table(stream).select(F.to_timestamp_ntz(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss")).alias("bucket"), "event_type", "count")


_MIRROR = "SELECT user_id AS project_id, ts::DATE AS date, count(*) FILTER (WHERE event_type = 'view') AS queries_count, count(*) FILTER (WHERE event_type = 'click') AS clicks_count FROM events GROUP BY ALL"


@query(f"SELECT project_id, date, queries_count, clicks_count FROM ({_MIRROR}) WHERE date >= DATE '2024-01-20' - 7")
def analytics_mirror(spark, sf_dir):
    kinds = lambda k, name: F.count_if(F.col("event_type") == k).alias(name)
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("project_id"), F.to_date("ts").alias("date")).agg(kinds("view", "queries_count"), kinds("click", "clicks_count"))
    return analytics.mirrored(daily, DAY, 7)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS r FROM events) WHERE r <= 1000 GROUP BY 1")
def stream_recent_means(spark, sf_dir):
    stream = counters.recent_means(counters.read_events(spark, f"{sf_dir}/events.parquet"))
    return counters.to_table(stream, ["event_type"]).select("event_type", "n", F.round("mean", 6).alias("mean"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT date_trunc('hour', ts)) AS buckets FROM events GROUP BY 1")
def stream_bucketed_means(spark, sf_dir):
    stream = counters.bucketed_means(counters.read_events(spark, f"{sf_dir}/events.parquet"), kept="3650 days")
    return counters.to_table(stream, ["event_type"], rocks=True).select("event_type", "n", F.round("mean", 6).alias("mean"), "buckets")
