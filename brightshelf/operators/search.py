"""Ranked keyword search of many queries at once: synonyms, layout and n-gram fallbacks, filters, sorting, paging."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: What a hit of a fallback keeps of its score.
LAYOUT, NGRAM = 0.9, 0.5
#: Queries of a batch that are a constant of the plan, and tokens that are looked for in the scan of the postings.
BATCH, TOKENS_PUSHED = 10_000, 1000
#: Hits of a task.
HITS_EACH = 100_000
#: Ranks up to which a window's limit works before its rows are shuffled (spark.sql.optimizer.windowGroupLimitThreshold).
RANKED_IN_TASKS = 1000
#: Other layouts of a query, and stages of a search, at most.
LAYOUTS, STAGES = 2, 3
#: The limit that stands for "all", and the one of a request that names none.
ALL, DEFAULT_LIMIT = 10_000, 50


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    ngrams: DataFrame


def as_list(value) -> list:
    """A scalar is a list of one; nothing is none."""
    return [] if value is None else list(value) if isinstance(value, (list, tuple, set)) else [value]


def prepared(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, project_id, q, perhaps limit) with normalized, tokens and layout_variants."""
    limit = ["limit"] if "limit" in queries.columns else []
    return queries.select("query_id", F.coalesce("project_id", F.lit("demo")).alias("project_id"), "q", *limit, *X.process("q"))


def expand_synonyms(processed: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    """(query_id, project_id, pos, token): the tokens in order, then what their synonym groups add.

    ``synonyms`` is (project_id, group_pos, words). For each token in turn the first group that has it, whatever the case,
    adds its words in lower case that are not there yet.
    """
    base = processed.select("query_id", "project_id", F.posexplode("tokens").alias("pos", "token"))
    if synonyms is None:
        return base
    words = synonyms.select("project_id", "group_pos", F.transform("words", F.lower).alias("words"))
    of_word = words.select("project_id", "group_pos", F.explode("words").alias("token")).groupBy("project_id", "token").agg(F.min("group_pos").alias("group_pos"))
    grouped = base.join(of_word, ["project_id", "token"]).join(words, ["project_id", "group_pos"])
    added = grouped.select("query_id", "project_id", F.col("pos").alias("of"), F.posexplode("words").alias("at", "token"))
    added = added.groupBy("query_id", "project_id", "token").agg(F.min(F.struct("of", "at")).alias("first")).join(base.select("query_id", "token").distinct(), ["query_id", "token"], "left_anti")
    after = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    sizes = processed.select("query_id", F.size("tokens").alias("n"))
    return base.unionByName(added.join(sizes, "query_id").select("query_id", "project_id", (F.col("n") + after - 1).alias("pos"), "token"))


def _scored(tokens: DataFrame, postings: DataFrame, *also: str) -> DataFrame:
    """Sum of the postings of each query's tokens, with the first token that hit and its posting's score.

    Place and score of the first are one number, so that the aggregation is by hashing: the place above 44 bits that hold
    the score in steps of 2 ** -16 (scores are multiples of 0.5).
    """
    hits = tokens.join(postings, ["project_id", "token"])
    placed = F.shiftleft(F.col("pos").cast("long"), 44) + F.least((F.col("score") * 65536).cast("long"), F.lit((1 << 44) - 1))
    found = hits.groupBy("query_id", *also, "project_id", "product_id").agg(F.sum("score").alias("score"), F.min(placed).alias("f"))
    score = F.col("f").bitwiseAND(F.lit((1 << 44) - 1)) / 65536
    return found.select("query_id", *also, "project_id", "product_id", "score", F.shiftright("f", 44).cast("int").alias("first_pos"), score.alias("first_score"))


def token_hits(processed: DataFrame, postings: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(query_id, product_id, score, stage 0, ...): what the expanded tokens find."""
    out = _scored(expand_synonyms(processed, synonyms), postings)
    return out.withColumns({"stage": F.lit(0), "variant": F.lit(0)})


def layout_hits(processed: DataFrame, postings: DataFrame) -> DataFrame:
    """What the first variant in another keyboard layout finds that finds a product at all."""
    variants = processed.select("query_id", "project_id", F.posexplode("layout_variants").alias("variant", "v"))
    tokens = variants.select("query_id", "project_id", "variant", F.posexplode(X.tokenize("v")).alias("pos", "token"))
    best = _of_least(_scored(tokens, postings, "variant"), "variant", LAYOUTS, ("score", "first_pos", "first_score"))
    return best.withColumns({"score": F.col("score") * LAYOUT, "stage": F.lit(1)})


def synonym_lists(tokens: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, pos, words): each token of ``tokens`` (query_id, pos, token) with the words that ``synonyms`` (word, synonyms)
    has for it."""
    known = synonyms.select(F.col("word").alias("token"), "synonyms")
    words = F.array_distinct(F.concat(F.array("token"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    return tokens.join(known, "token", "left").select("query_id", "pos", words.alias("words"))


def similar_tokens(tokens: DataFrame, ngrams: DataFrame, cut=X.ngrams) -> DataFrame:
    """(project_id, token, match, similarity): indexed tokens that share an n-gram, by Jaccard similarity of the n-grams.

    Tokens are compared once each, whatever the number of queries that have them. The shared n-grams are counted by the
    join itself, so no sets are compared.
    """
    distinct = tokens.select("project_id", "token").distinct()
    own = distinct.select("project_id", "token", F.array_distinct(cut("token")).alias("g"))
    sized = own.select("project_id", "token", F.size("g").alias("n_own"), F.explode("g").alias("ngram"))
    shared = sized.join(ngrams.withColumnRenamed("token", "match"), ["project_id", "ngram"]).groupBy("project_id", "token", "match", "n_own").agg(F.count("*").alias("common"))
    n_match = F.size(F.array_distinct(cut("match")))
    similarity = F.when(F.col("token") == F.col("match"), 1.0).otherwise(F.col("common") / (F.col("n_own") + n_match - F.col("common")))
    return shared.select("project_id", "token", "match", similarity.alias("similarity"))


def ngram_hits(processed: DataFrame, index: Index, keep: float = NGRAM, above: float | None = None, cut=X.ngrams, few: bool = False) -> DataFrame:
    """What tokens find that share an n-gram with the query's: postings times similarity. ``cut`` makes the n-grams, as it did
    those of the index; with ``above``, less similar tokens are left out. With ``few``, the n-grams of the query and the
    tokens that they find are asked for first, so that both are looked for in the scans."""
    tokens = processed.select("query_id", "project_id", F.explode("tokens").alias("token"))
    ngrams, postings = index.ngrams, index.postings
    if few:
        own = tokens.select("project_id", F.explode(cut("token")).alias("ngram")).distinct().take(TOKENS_PUSHED + 1)
        if len(own) <= TOKENS_PUSHED:
            ngrams = ngrams.where(F.col("project_id").isin(sorted({r["project_id"] for r in own})) & F.col("ngram").isin(sorted({r["ngram"] for r in own})))
    alike = similar_tokens(tokens, ngrams, cut)
    if above is not None:
        alike = alike.where(F.col("similarity") > above)
    if few:
        found = alike.take(TOKENS_PUSHED + 1)
        if len(found) <= TOKENS_PUSHED:
            alike = literal_rows(processed.sparkSession, [r.asDict() for r in found], "project_id string, token string, match string, similarity double")
            postings = of_tokens(postings, {(r["project_id"], r["match"]) for r in found})
    hits = tokens.join(alike, ["project_id", "token"]).join(postings.withColumnRenamed("token", "match"), ["project_id", "match"])
    out = hits.groupBy("query_id", "project_id", "product_id").agg(F.bround(F.sum(F.col("score") * F.col("similarity")) * keep, 9).alias("score"))
    return out.withColumns({"first_pos": F.lit(0), "first_score": F.lit(0.0), "stage": F.lit(2), "variant": F.lit(0)})


def _of_least(hits: DataFrame, by: str, n: int, columns: tuple[str, ...]) -> DataFrame:
    """Each product of a query once, with what it has under the least ``by`` of its hits; ``by`` is one of 0 .. n - 1.

    A column for each value of ``by``, so that the aggregation is by hashing.
    """
    under = [F.max(F.when(F.col(by) == k, F.col(c))).alias(f"{c}_{k}") for c in columns for k in range(n)]
    found = hits.groupBy("query_id", "project_id", "product_id").agg(F.min(by).alias(by), *under)
    first = lambda c: reduce(lambda rest, k: F.when(F.col(by) == k, F.col(f"{c}_{k}")).otherwise(rest), reversed(range(n - 1)), F.col(f"{c}_{n - 1}"))
    return found.select("query_id", "project_id", "product_id", by, *(first(c).alias(c) for c in columns))


def _earliest(hits: DataFrame) -> DataFrame:
    """Each product of a query in the first stage that found it."""
    return _of_least(hits, "stage", STAGES, ("variant", "score", "first_pos", "first_score"))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of the caller's as a constant of the plan. The optimizer knows that they are few, so what they are joined with is
    not shuffled for them."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _unbounded(queries: DataFrame, index: Index, synonyms: DataFrame | None) -> DataFrame:
    """candidates() of a table of queries: each stage is part of one plan."""
    processed = prepared(queries)
    found = _earliest(token_hits(processed, index.postings, synonyms).unionByName(layout_hits(processed, index.postings)))
    counts = found.groupBy("query_id").agg(F.count_if(F.col("stage") == 0).alias("direct"), F.count("*").alias("all"))
    few = F.coalesce("direct", F.lit(0)) < F.col("limit")
    gate = processed.join(counts, "query_id", "left").withColumn("few", few)
    kept = found.join(gate.select("query_id", "few"), "query_id").where((F.col("stage") == 0) | F.col("few")).drop("few")
    short = gate.where(F.coalesce(F.when(F.col("few"), F.col("all")).otherwise(F.col("direct")), F.lit(0)) < F.col("limit"))
    return _earliest(kept.unionByName(ngram_hits(short, index)))


def of_tokens(postings: DataFrame, tokens: set[tuple[str, str]]) -> DataFrame:
    """The postings of some (project_id, token); with few tokens the filter reaches the scan, where they lie together."""
    if len(tokens) > TOKENS_PUSHED:
        return postings
    return postings.where(F.col("project_id").isin(sorted({p for p, _ in tokens})) & F.col("token").isin(sorted({t for _, t in tokens})))


def _staged(queries: DataFrame, index: Index, synonyms: DataFrame | None) -> tuple[DataFrame, int]:
    """candidates(), and the highest limit."""
    processed = prepared(queries)
    rows = processed.take(BATCH + 1)
    if len(rows) > BATCH:
        return _unbounded(queries, index, synonyms), queries.agg(F.max("limit")).first()[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in processed.schema)
    literal = lambda some: literal_rows(queries.sparkSession, [r.asDict() for r in some], schema)
    words = expand_synonyms(literal(rows), synonyms).collect() if synonyms is not None else [{**r.asDict(), "token": t} for r in rows for t in r["tokens"]]
    wanted = {(w["project_id"], w["token"]) for w in words}
    postings = of_tokens(index.postings, wanted)
    sized = literal_rows(queries.sparkSession, [{"project_id": p, "token": t} for p, t in wanted], "project_id string, token string").join(postings, ["project_id", "token"])
    sizes = {(r["project_id"], r["token"]): r["n"] for r in sized.groupBy("project_id", "token").agg(F.count("*").alias("n")).collect()} if wanted else {}
    most: dict = {}
    for w in words:
        most[w["query_id"]] = max(most.get(w["query_id"], 0), sizes.get((w["project_id"], w["token"]), 0))
    rare = [r for r in rows if most.get(r["query_id"], 0) < r["limit"]]
    plain = [r for r in rows if most.get(r["query_id"], 0) >= r["limit"]]
    # Each posting is dealt once, by its product; so a task has all postings of its products, whatever the number of queries
    # that have their tokens, and what is aggregated and ranked for a query need not be shuffled but for its best few.
    # The tasks are as many as the hits call for, not the few that the postings alone would.
    hits = sum(sizes.get((w["project_id"], w["token"]), 0) for w in words)
    parts = min(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + hits // HITS_EACH)
    postings = postings.repartition(parts, "project_id", "product_id")
    found = [token_hits(literal(plain), postings, synonyms)] if plain or not rare else []
    if rare:
        asked = literal(rare)
        typed = asked.select("project_id", F.explode("layout_variants").alias("v")).select("project_id", F.explode(X.tokenize("v")).alias("token")).distinct().collect()
        others = of_tokens(index.postings, {(r["project_id"], r["token"]) for r in typed})
        stages = [token_hits(asked, postings, synonyms)] + ([layout_hits(asked, others)] if typed else [])
        both = _earliest(reduce(DataFrame.unionByName, stages))
        counts = {r["query_id"]: r for r in both.groupBy("query_id").agg(F.count_if(F.col("stage") == 0).alias("direct"), F.count("*").alias("all")).collect()}
        few = [r for r in rare if r["query_id"] not in counts or counts[r["query_id"]]["direct"] < r["limit"]]
        short = [r for r in few if r["query_id"] not in counts or counts[r["query_id"]]["all"] < r["limit"]]
        kept = both.where((F.col("stage") == 0) | F.col("query_id").isin([r["query_id"] for r in few]))
        found.append(_earliest(kept.unionByName(ngram_hits(literal(short), index, few=True))) if short else kept)
    return reduce(DataFrame.unionByName, found), max((r["limit"] for r in rows), default=0)


def best_alike(postings: DataFrame, tokens: set[tuple[str, str]], k: int) -> DataFrame:
    """The postings of ``tokens`` (project_id, token) without those of products that can't be among the k best of any query.

    Products that have the same of these tokens with the same scores differ in a ranking by relevance in their id alone, so
    of each class of them the k with the greatest ids stay; each other one has k of its class before it. A class is named by
    the number of its tokens and 128 bits. So a query meets classes, not products. Ids are ranked in the tasks that have the
    products, which pass on k of a class.
    """
    wanted = literal_rows(postings.sparkSession, [{"project_id": p, "token": t} for p, t in sorted(tokens)], "project_id string, token string")
    # Each posting is dealt once, by its product.
    dealt = postings.join(F.broadcast(wanted), ["project_id", "token"], "left_semi").repartition("project_id", "product_id")
    if k > RANKED_IN_TASKS:
        return dealt
    name = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "token", "score"))
    products = dealt.groupBy("project_id", "product_id").agg(F.count("*").alias("n"), name(1).alias("a"), name(2).alias("b"))
    place = F.row_number().over(Window.partitionBy("project_id", "n", "a", "b").orderBy(F.desc("product_id")))
    best = products.withColumn("place", place).where(F.col("place") <= k).select("project_id", "product_id")
    return dealt.join(best, ["project_id", "product_id"], "left_semi")


def candidates(queries: DataFrame, index: Index, synonyms: DataFrame | None = None) -> DataFrame:
    """The hits of each query (query_id, project_id, q, limit), without order.

    A query with fewer hits than its limit is tried in other keyboard layouts; if it still has fewer, by n-grams. A
    fallback adds products that are not there yet.

    A batch of up to BATCH queries is a constant of the plan, and what a stage leaves to do is asked of the index before the
    next one is planned: first, by one count for each of its tokens, which queries may have too few hits at all, as none of
    their tokens alone is in as many products as they ask for; then, of those, which need n-grams. So most batches are one
    join of tokens with postings. More queries than that are one plan with all stages.
    """
    return _staged(queries, index, synonyms)[0]


#: Hits of one query from the best on.
RELEVANCE = ("score DESC", "stage", "variant", "first_pos", "first_score DESC", "product_id DESC")


def relevance() -> list[Column]:
    return [F.desc(k.split()[0]) if k.endswith("DESC") else F.asc(k) for k in RELEVANCE]


def merit() -> list[Column]:
    """The columns of RELEVANCE as values of which the greater comes first."""
    return [F.col(k.split()[0]) if k.endswith("DESC") else (-F.col(k)).alias(k) for k in RELEVANCE]


def price() -> Column:
    return F.coalesce("price", F.lit(0.0))


def non_price_filter(filters: dict | None) -> Column:
    """in_stock (only if true), category (any of), params (each key any of its values)."""
    f = filters or {}
    tests = [F.lit(True)]
    if f.get("in_stock"):
        tests.append(F.coalesce("in_stock", F.lit(False)))
    if categories := as_list(f.get("category")):
        tests.append(F.coalesce(F.col("category").isin(categories), F.lit(False)))
    for key, allowed in (f.get("params") or {}).items():
        if values := as_list(allowed):
            tests.append(F.coalesce(F.try_element_at("params", F.lit(key)).isin(values), F.lit(False)))
    return reduce(Column.__and__, tests)


def price_filter(filters: dict | None) -> Column:
    f = filters or {}
    low, high = f.get("min_price", f.get("price_min")), f.get("max_price", f.get("price_max"))
    tests = [F.lit(True)] + [price() >= low] * (low is not None) + [price() <= high] * (high is not None)
    return reduce(Column.__and__, tests)


def loaded(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Hits with their products; hits of products that are gone are left out."""
    return hits.join(catalog.withColumnRenamed("id", "product_id"), ["project_id", "product_id"])


def passing(hits: DataFrame, catalog: DataFrame, filters: dict | None = None, sort: str = "relevance", needs_products: bool = False) -> tuple[DataFrame, list[Column]]:
    """Hits after filters, and the order of ``sort``.

    Where products are needed (filters, facets or a price order), those out of stock come last whatever the order.
    Without, products are not read, and stock plays no part.
    """
    if not filters and sort not in ("price_asc", "price_desc") and not needs_products:
        return hits, relevance()
    rows = loaded(hits, catalog).where(non_price_filter(filters) & price_filter(filters))
    by_price = {"price_asc": [price().asc()], "price_desc": [price().desc()]}.get(sort, [])
    return rows, [(~F.coalesce("in_stock", F.lit(True))).asc(), *by_price, *relevance()]


def search(
    queries: DataFrame, index: Index, catalog: DataFrame, offset: int = 0, filters: dict | None = None, sort: str = "relevance", facets: bool = False, synonyms: DataFrame | None = None
) -> DataFrame:
    """(query_id, position, id, name, score, total, ...): a page of each query's results.

    ``queries`` is (query_id, project_id, q, limit). ``total`` counts what passes the filters; ``score`` is rounded to 2
    places. A query without tokens has no rows. Ranks end at the batch's highest limit, so each task passes on no more
    rows of a query than that; totals are counted where the hits lie.
    """
    hits, limit = _staged(queries, index, synonyms)
    rows, order = passing(hits, catalog, filters, sort, facets)
    # Counted with the columns that ranks are made of, so that both read the same exchange.
    totals = rows.groupBy("query_id").agg(F.count_if(F.col("score").isNotNull() & F.col("first_score").isNotNull()).alias("total"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    top = rows.withColumn("position", position).where(F.col("position") <= offset + limit).select("query_id", "project_id", "product_id", "position", "score")
    page = top.join(queries.select("query_id", "limit"), "query_id").where((F.col("position") > offset) & (F.col("position") <= offset + F.col("limit")))
    out = loaded(page.join(totals, "query_id"), catalog)
    return out.select("query_id", "position", F.col("product_id").alias("id"), "name", F.bround("score", 2).alias("score"), "total", "price", "in_stock", "category", "brand")


def request_limit(limit: int | None) -> int:
    """-1 is all; else within -1 .. 10000."""
    n = DEFAULT_LIMIT if limit is None else limit
    if not -1 <= n <= ALL:
        raise ValueError("limit must be within -1 .. 10000")
    return ALL if n == -1 else n


def overlaid(filters: dict | None, **legacy) -> dict:
    """The filters of a request: single parameters, over which the structured ones are laid."""
    return {k: v for k, v in legacy.items() if v is not None} | (filters or {})
