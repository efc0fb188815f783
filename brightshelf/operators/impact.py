"""The best results of a query without reading whole postings: lists in blocks of equal impact, of which those that cannot win stay unread."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import search

#: Postings of a token whose scores lie between two multiples of this are one block.
STEP = 0.25
#: What sums of scores may differ by from the order of their addition.
SLACK = 1e-6
#: Candidates whose ids are looked for in the scan of the postings; where there are more, whole lists are read.
CANDIDATES = 200
#: The share of a query's postings from which on reading some before others saves nothing.
MOST = 0.5


@dataclass(frozen=True)
class Impacts:
    """``blocks``: postings with their impact, laid out by token, impact and product. ``heads``: (project_id, token, impact, n,
    upper, lower). ``ngrams`` as in search.Index. ``gone``: at most so many products are counted in heads that blocks no
    longer have."""

    blocks: DataFrame
    heads: DataFrame
    ngrams: DataFrame
    gone: int = 0

    def index(self) -> search.Index:
        return search.Index(self.blocks.drop("impact"), self.ngrams)


def order() -> list:
    """The layout of blocks: of a token the highest impact first, and in a block by product, so that a filter on some products
    finds few pages of it."""
    return ["project_id", "token", F.desc("impact"), "product_id"]


def blocks(postings: DataFrame) -> DataFrame:
    return postings.withColumn("impact", F.ceil(F.col("score") / STEP).cast("int"))


def heads(blocks: DataFrame) -> DataFrame:
    """(project_id, token, impact, n, upper, lower) of each block. A token has as many as it has different impacts."""
    return blocks.groupBy("project_id", "token", "impact").agg(F.count("*").alias("n"), F.max("score").alias("upper"), F.min("score").alias("lower"))


def cuts(weights: dict[str, int], blocks: dict[str, list[tuple[float, float, int]]], k: int) -> tuple[float, dict[str, int]] | None:
    """What a query must read: (threshold, {token: number of its blocks}); None where no token alone has k products.

    ``weights`` says how often the query has a token, ``blocks`` has (upper, lower, n) of its blocks, the highest first. The
    k-th best posting of a token bounds the k-th best sum from below. A product that is in no block that was read has at
    most the sum of the highest scores that are left, so blocks are read, those first that lower this sum most for their
    rows, until it is below that bound: from then on, all of the best k are among what was read.
    """
    threshold = 0.0
    for t, m in weights.items():
        seen = 0
        for _, lower, n in blocks.get(t, ()):
            seen += n
            if seen >= k:
                threshold = max(threshold, m * lower)
                break
    if threshold <= 0:
        return None
    read = dict.fromkeys(weights, 0)
    left = lambda t, at: weights[t] * blocks[t][at][0] if at < len(blocks.get(t, ())) else 0.0
    while sum(left(t, at) for t, at in read.items()) >= threshold - SLACK:
        best = max((t for t, at in read.items() if left(t, at) > 0), key=lambda t: ((left(t, read[t]) - left(t, read[t] + 1)) / blocks[t][read[t]][2], t))
        read[best] += 1
    return threshold, read


def _heads_of(idx: Impacts, wanted: set[tuple[str, str]]) -> dict[tuple[str, str], list[tuple[float, float, int]]]:
    """The blocks of some (project_id, token); they are asked for by the query, so what comes to the driver grows with it alone."""
    if not wanted:
        return {}
    asked = search.literal_rows(idx.heads.sparkSession, [{"project_id": p, "token": t} for p, t in wanted], "project_id string, token string")
    rows = asked.join(search.of_tokens(idx.heads, wanted), ["project_id", "token"]).groupBy("project_id", "token", "impact").agg(F.sum("n").alias("n"), F.max("upper").alias("upper"), F.min("lower").alias("lower")).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: -r["impact"]):
        out.setdefault((r["project_id"], r["token"]), []).append((r["upper"], r["lower"], r["n"], r["impact"]))
    return out


def _filter(tokens: dict[tuple[str, str], int | None]):
    """A condition on blocks: each token's from an impact on (None: none of them); it reaches the scan."""
    by = [(F.col("project_id") == p) & (F.col("token") == t) & (F.col("impact") >= low) for (p, t), low in tokens.items() if low is not None]
    return reduce(lambda a, b: a | b, by, F.lit(False))


def planned(queries: list[dict], idx: Impacts, offset: int = 0) -> tuple[list[dict], list[dict], DataFrame | None]:
    """(queries that are answered by ``postings``, all others, postings): rows of search.prepared() with their tokens.

    The postings are those of all products that can be among the best of these queries, with all of the queries' tokens, so
    that their sums are whole.
    """
    wanted = {(q["project_id"], t) for q in queries for t in q["tokens"]}
    found = _heads_of(idx, wanted)
    served, others, pieces, lowest, rows_read, rows_all = [], [], [], {}, 0, 0
    for q in queries:
        weights, project = Counter(q["tokens"]), q["project_id"]
        of = {t: found.get((project, t), []) for t in weights}
        plan = cuts(weights, {t: [b[:3] for b in bs] for t, bs in of.items()}, q["limit"] + offset + idx.gone)
        if plan is None:
            others.append(q)
            continue
        served.append(q)
        threshold, read = plan
        rest = {t: weights[t] * of[t][at][0] if at < len(of[t]) else 0.0 for t, at in read.items()}
        for t, at in read.items():
            rows_all += sum(b[2] for b in of[t])
            rows_read += sum(b[2] for b in of[t][:at])
            if at:
                low = of[t][at - 1][3]
                lowest[project, t] = min(lowest.get((project, t), low), low)
                # What a product that is seen here has at most: its sum, and of the tokens that it was not seen with what is left.
                pieces.append({"query_id": q["query_id"], "project_id": project, "token": t, "low": low, "times": weights[t], "rest": rest[t], "missing": sum(rest.values()) - threshold})
    if not served:
        return served, others, None
    tokens = {(q["project_id"], t) for q in served for t in q["tokens"]}
    every = search.of_tokens(idx.blocks, tokens)
    # Queries that share tokens read their lists once when these are read whole.
    rows_once = sum(b[2] for t in tokens for b in found.get(t, ()))
    if rows_read > MOST * min(rows_all, rows_once) or len(lowest) > search.TOKENS_PUSHED // 10:
        return served, others, every
    schema = "query_id int, project_id string, token string, low int, times int, rest double, missing double"
    asked = search.literal_rows(idx.blocks.sparkSession, pieces, schema)
    hits = asked.join(idx.blocks.where(_filter(lowest)), ["project_id", "token"]).where("impact >= low")
    bound = F.sum(F.col("times") * F.col("score") - F.col("rest")) + F.max("missing")
    able = hits.groupBy("query_id", "project_id", "product_id").agg(bound.alias("over")).where(F.col("over") >= -SLACK)
    ids = [r[0] for r in able.select("product_id").distinct().take(CANDIDATES + 1)]
    return served, others, every if len(ids) > CANDIDATES else every.where(F.col("product_id").isin(ids))


def top(queries: DataFrame, idx: Impacts, catalog: DataFrame, offset: int = 0) -> DataFrame:
    """A page of each query's results as search.search() gives it by relevance, without ``total``.

    Lists are read from their highest impacts on, as far as ``cuts`` says, and of the products that these show to be able to
    win the other postings are looked up. Where whole lists are read, products that are alike to all queries of the batch are
    ranked once (search.best_alike). So a token that nearly all products have is not read for a query that has a better
    one. Queries of which no token alone has as many products as they ask for go the way of search.search(), with its
    fallbacks; so do batches of more than search.BATCH.
    """
    processed = search.prepared(queries)
    rows = [r.asDict() for r in processed.take(search.BATCH + 1)]
    columns = ["query_id", "position", "id", "name", "score", "price", "in_stock", "category", "brand"]
    if len(rows) > search.BATCH:
        return search.search(queries, idx.index(), catalog, offset).select(columns)
    served, others, postings = planned(rows, idx, offset)
    spark, parts = queries.sparkSession, []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in processed.schema)
    if others or not served:
        some = search.literal_rows(spark, [{k: q[k] for k in ("query_id", "project_id", "q", "limit")} for q in others], "query_id int, project_id string, q string, `limit` int")
        parts.append(search.search(some, idx.index(), catalog, offset).select(columns))
    if served:
        asked, most = search.literal_rows(spark, served, schema), max(q["limit"] for q in served)
        wanted = {(q["project_id"], t) for q in served for t in q["tokens"]}
        hits = search.token_hits(asked, search.best_alike(postings, wanted, offset + most))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*search.relevance()))
        best = hits.withColumn("position", place).where(F.col("position") <= offset + most)
        page = best.join(asked.select("query_id", "limit"), "query_id").where((F.col("position") > offset) & (F.col("position") <= offset + F.col("limit")))
        out = search.loaded(page.select("query_id", "project_id", "product_id", "position", "score"), catalog)
        parts.append(out.select("query_id", "position", F.col("product_id").alias("id"), "name", F.bround("score", 2).alias("score"), "price", "in_stock", "category", "brand"))
    return reduce(DataFrame.unionByName, parts)
