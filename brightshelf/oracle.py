"""The same queries as SQL for an independent engine."""

from __future__ import annotations

from .functions import words as W


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "CAST([" + ", ".join(map(text, values)) + "] AS VARCHAR[])"


STOP = strings(W.STOP_WORDS)

CATALOG = """catalog AS (
  SELECT 'demo' AS project_id, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(NULL AS VARCHAR) AS description, p_retailprice AS price,
    CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 1.25 END AS old_price, p_partkey % 7 <> 0 AS in_stock, p_type AS category,
    'c' || CAST(length(p_type) AS VARCHAR) AS category_id, p_brand AS brand, 'PN-' || CAST(p_partkey AS VARCHAR) AS vendor_code,
    CAST(p_size AS VARCHAR) AS size, split_part(p_name, ' ', 1) AS color
  FROM part)"""


def normalize(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower({c}), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}_\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def tokenize(normalized: str, stop: str = STOP) -> str:
    """The order-dependent token list as a fold over one-element lists."""
    joined = "replace(x[1], '-', '')"
    base = "(CASE WHEN length(x[1]) > 1 THEN list_append(acc, x[1]) ELSE acc END)"
    with_joined = f"(CASE WHEN length({joined}) > 1 AND NOT list_contains({base}, {joined}) THEN list_append({base}, {joined}) ELSE {base} END)"
    part = f"CASE WHEN length(y[1]) > 1 AND NOT list_contains({stop}, y[1]) AND NOT list_contains(a, y[1]) THEN list_append(a, y[1]) ELSE a END"
    parts = f"list_reduce(list_concat([{with_joined}], list_transform(string_split(x[1], '-'), lambda p: [p])), lambda a, y: {part})"
    step = f"CASE WHEN list_contains({stop}, x[1]) THEN acc WHEN contains(x[1], '-') THEN {parts} WHEN length(x[1]) > 1 THEN list_append(acc, x[1]) ELSE acc END"
    words = f"list_transform(list_filter(string_split({normalized}, ' '), lambda w: w <> ''), lambda w: [w])"
    return f"list_reduce(list_concat([CAST([] AS VARCHAR[])], {words}), lambda acc, x: {step})"


def layout(c: str, to_russian: bool = True) -> str:
    a, b = (W.LATIN_KEYS, W.RUSSIAN_KEYS) if to_russian else (W.RUSSIAN_KEYS, W.LATIN_KEYS)
    return f"translate(lower({c}), {text(a)}, {text(b)})"


def variants(n: str) -> str:
    ru, la = layout(n), layout(n, False)
    return f"list_filter([CASE WHEN {ru} <> {n} THEN {ru} END, CASE WHEN {la} <> {n} AND {la} <> {ru} THEN {la} END], lambda v: v IS NOT NULL)"


def ngrams(c: str, n: int = 3) -> str:
    return f"list_transform(range(1, greatest(length({c}) - {n - 2}, 2)), lambda i: substring({c}, i, {n}))"


POSTINGS = f"""fields AS (
  SELECT id, name AS t, 3.0::DOUBLE AS w FROM catalog UNION ALL SELECT id, brand, 2.0 FROM catalog UNION ALL SELECT id, category, 1.5 FROM catalog
  UNION ALL SELECT id, vendor_code, 3.0 FROM catalog UNION ALL SELECT id, size, 2.0 FROM catalog UNION ALL SELECT id, color, 2.0 FROM catalog),
cut AS (SELECT id, w, unnest({tokenize(normalize("t"))}) AS token FROM fields),
postings AS (SELECT token, id AS product_id, sum(w) AS score FROM cut GROUP BY ALL)"""
NGRAMS = f"ngrams AS (SELECT DISTINCT unnest({ngrams('token')}) AS ngram, token FROM (SELECT DISTINCT token FROM postings))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def hits(queries: list[tuple[str, int]], synonyms: list[list[str]] | None = None) -> tuple[str, ...]:
    """The parts that end in ``hits``: every hit of every query with what it is ordered by."""
    values = ", ".join(f"({k}, {text(q)}, {limit})" for k, (q, limit) in enumerate(queries))
    asked = f"asked AS (SELECT query_id, q, lim, n, {tokenize('n')} AS tokens, {variants('n')} AS vs FROM (SELECT *, {normalize('q')} AS n FROM (VALUES {values}) v(query_id, q, lim)))"
    base = "base AS (SELECT query_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM asked)"
    if synonyms:
        rows = ", ".join(f"({k}, {j}, {text(w.lower())})" for k, g in enumerate(synonyms) for j, w in enumerate(g))
        extra = f"""syn AS (SELECT * FROM (VALUES {rows}) s(g, place, word)),
of_word AS (SELECT word, min(g) AS g FROM syn GROUP BY word),
more AS (SELECT b.query_id, s.word AS token, min({{'o': b.pos, 'a': s.place}}) AS first FROM base b JOIN of_word o ON o.word = b.token JOIN syn s ON s.g = o.g
  WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.query_id = b.query_id AND x.token = s.word) GROUP BY ALL),
expanded AS (SELECT query_id, token, pos FROM base UNION ALL
  SELECT m.query_id, m.token, len(a.tokens) + row_number() OVER (PARTITION BY m.query_id ORDER BY first) - 1 FROM more m JOIN asked a USING (query_id))"""
    else:
        extra = "expanded AS (SELECT * FROM base)"
    direct = """s0 AS (SELECT query_id, product_id, sum(score) AS score, 0 AS stage, 0 AS variant, min(pos) AS first_pos, arg_min(score, pos) AS first_score
  FROM expanded JOIN postings USING (token) GROUP BY query_id, product_id),
short1 AS (SELECT a.* FROM asked a LEFT JOIN (SELECT query_id, count(*) AS c FROM s0 GROUP BY 1) USING (query_id) WHERE coalesce(c, 0) < lim)"""
    by_layout = f"""vt AS (SELECT query_id, variant, unnest(tk) AS token, unnest(range(len(tk))) AS pos FROM (
  SELECT query_id, variant, {tokenize('v')} AS tk FROM (SELECT query_id, unnest(vs) AS v, unnest(range(len(vs))) AS variant FROM short1))),
v1 AS (SELECT query_id, variant, product_id, sum(score) AS score, min(pos) AS first_pos, arg_min(score, pos) AS first_score FROM vt JOIN postings USING (token) GROUP BY ALL),
s1 AS (SELECT query_id, product_id, arg_min(score, variant) * 0.9 AS score, 1 AS stage, min(variant) AS variant, arg_min(first_pos, variant) AS first_pos, arg_min(first_score, variant) AS first_score
  FROM v1 WHERE NOT EXISTS (SELECT 1 FROM s0 WHERE s0.query_id = v1.query_id AND s0.product_id = v1.product_id) GROUP BY query_id, product_id),
s01 AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
short2 AS (SELECT a.* FROM asked a LEFT JOIN (SELECT query_id, count(*) AS c FROM s01 GROUP BY 1) USING (query_id) WHERE coalesce(c, 0) < lim)"""
    sets = lambda t: f"list_distinct({ngrams(t)})"
    by_ngram = f"""nt AS (SELECT query_id, unnest(tokens) AS token FROM short2),
alike AS (SELECT DISTINCT d.token, n.token AS match FROM (SELECT DISTINCT token, unnest({ngrams('token')}) AS ngram FROM nt) d JOIN ngrams n USING (ngram)),
sim AS (SELECT token, match, CASE WHEN token = match THEN 1.0 ELSE len(list_intersect({sets('token')}, {sets('match')}))::DOUBLE / len(list_distinct(list_concat({sets('token')}, {sets('match')}))) END AS similarity FROM alike),
s2 AS (SELECT query_id, product_id, round_even(sum(score * similarity) * 0.5, 9) AS score, 2 AS stage, 0 AS variant, 0 AS first_pos, 0.0 AS first_score
  FROM nt JOIN sim USING (token) JOIN postings p ON p.token = sim.match GROUP BY query_id, product_id),
hits AS (SELECT * FROM s01 UNION ALL SELECT * FROM s2 WHERE NOT EXISTS (SELECT 1 FROM s01 WHERE s01.query_id = s2.query_id AND s01.product_id = s2.product_id))"""
    return (CATALOG, POSTINGS, NGRAMS, asked, base, extra, direct, by_layout, by_ngram)


ORDER = "score DESC, stage, variant, first_pos, first_score DESC, product_id DESC"
ROW = "query_id, position, c.id, c.name, round_even(score, 2) AS score, total, c.price, c.in_stock, c.category, c.brand"


def search(queries, synonyms=None, offset: int = 0, where: str | None = None, order: str = "", products: bool = False) -> str:
    needs = products or where is not None or bool(order)
    if needs:
        ranked = f"ranked AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY NOT in_stock, {order}{ORDER}) AS position, count(*) OVER (PARTITION BY query_id) AS total FROM hits h JOIN catalog ON id = product_id WHERE {where or 'true'})"
    else:
        ranked = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS position, count(*) OVER (PARTITION BY query_id) AS total FROM hits)"
    return with_(*hits(queries, synonyms), ranked) + f"\nSELECT {ROW} FROM ranked JOIN catalog c ON c.id = product_id JOIN asked USING (query_id) WHERE position > {offset} AND position <= {offset} + lim"


def faceted(queries, where: str, final: str) -> str:
    """``rows``: hits that pass all filters but the price, with their products and rank."""
    rows = f"rows AS (SELECT h.query_id, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank, c.* FROM hits h JOIN catalog c ON c.id = product_id)"
    return with_(*hits(queries), rows, f"passing AS (SELECT * FROM rows WHERE {where})") + "\n" + final


PAIRS = "pairs AS (SELECT query_id, rank, 0 AS place, 'size' AS key, size AS value FROM priced UNION ALL SELECT query_id, rank, 1, 'color', color FROM priced)"
PARAM_COUNTS = "counts AS (SELECT query_id, key, value, count(*) AS count, min({'r': rank, 'a': place}) AS seen FROM pairs GROUP BY ALL)"

LOG = """log AS (SELECT ts, 'query ' || json_extract_string(props, '$.k') AS query, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS results_count, value AS took_ms, event_id FROM events WHERE event_type = 'view'),
clicks AS (SELECT ts, json_extract_string(props, '$.k') AS product_id, ' Query  ' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 10 AS VARCHAR) || ' ' AS query FROM events WHERE event_type = 'click')"""
