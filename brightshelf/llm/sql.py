"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .urls import PATTERNS

_host = "translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_path = "regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_labels = sorted(p.literals[0] for p in PATTERNS)
_label = "CASE " + " ".join(f"WHEN regexp_matches(host, '(^|[^a-z0-9]){x}([^a-z0-9]|$)') THEN 'label:{x}'" for x in _labels) + " END"

op3_embedding_near_dedup = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT DISTINCT a AS node, a AS other FROM link UNION SELECT node, b FROM reach JOIN link ON a = other),
lowest AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON a = vec_id LEFT JOIN lowest ON node = vec_id"""

op6_url_filter = f"""
WITH parts AS (SELECT page_id, coalesce({_host}, '') AS host, coalesce({_path}, '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
labelled AS (SELECT *, {_label} AS label FROM parts)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN label IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN label END AS pattern
FROM labelled LEFT JOIN best USING (page_id)"""

op9_substring_dedup = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN least USING (s) WHERE m < doc_id) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed, sha256(array_to_string(list_filter(ws, lambda x, k: NOT list_contains(coalesce(ks, []), k)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""

op10_chat_format = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) t(i)),
e AS (SELECT *, length('<|turn ' || replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>') || ' |>.' || replace(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>') || '<|end|>.') AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def _codebooks() -> str:
    """Rounds are steps of the statement: a (entries of the vectors' parts), then b (the entries that result)."""
    squares = "CAST(list_sum(list_transform(range(1, len(x.c) + 1), lambda i: (x.c[i] - y.c[i]) * (x.c[i] - y.c[i]))) AS BIGINT)"
    steps = []
    for k in range(3):
        steps.append(f"a{k} AS (SELECT vec_id, label, p, any_value(x.c) AS c, min({{'d': {squares}, 'e': e}}) AS best FROM parts x JOIN b{k} y USING (p) GROUP BY vec_id, label, p)")
        if k < 2:
            steps.append(f"""m{k} AS (SELECT p, best.e AS e, i, CAST(sum(c[i + 1]) AS BIGINT) AS s, count(*) AS n FROM a{k}, range(4) t(i) GROUP BY ALL),
b{k + 1} AS (SELECT p, e, coalesce(new, c) AS c FROM b{k} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS new FROM m{k} GROUP BY p, e) USING (p, e))""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * 4 + 1:p * 4 + 4] AS c FROM kept, range(16) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{", ".join(steps)},
coded AS (SELECT vec_id, label, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(c[i + 1], ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b2, range(4) t(i))
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books"""


op11_vector_codes = _codebooks()

op13_fill_in_middle = """
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
drawn AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || substring(k, 1 + 8 * i, 8) AS BIGINT)) AS h, len(u) AS n FROM cut),
formed AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS p, coalesce(array_to_string(u[low + 1:high], ''), '') AS m, coalesce(array_to_string(u[high + 1:], ''), '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""

ALL = {name: sql for name, sql in globals().items() if name.startswith("op")}
