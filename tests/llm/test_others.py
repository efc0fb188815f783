"""Operators on vectors, pages and conversations, and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightshelf.llm import caps, chat, collisions, common, urls
from brightshelf.llm import queries as Q


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(k, (centres[k % 6] + rng.normal(size=16) * 0.12).astype(np.float32).tolist(), k % 3, "x") for k in range(300)]
    rows += [(1000 + k, rows[7][1], 1, "x") for k in range(30)] + [rows[11]]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(2000 + k, v, 0, None) for k, v in enumerate(odd)] + [(3000, rows[3][1], None, None), (None, rows[3][1], 0, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string").repartition(3).cache()


def fits(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, dtype=float), np.array(b, dtype=float)
    return float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()))


@pytest.mark.parametrize("hot", [512, 8])
def test_embedding_near_duplicates(vectors, hot, monkeypatch):
    monkeypatch.setattr(caps, "HOT", hot)
    rows = vectors.collect()
    n = len(rows)
    links = [[j for j in range(n) if j != i and rows[i]["label"] is not None and rows[i]["label"] == rows[j]["label"] and fits(rows[i]["embedding"]) and fits(rows[j]["embedding"]) and len(rows[i]["embedding"]) == len(rows[j]["embedding"]) and cosine(rows[i]["embedding"], rows[j]["embedding"]) >= 0.93] for i in range(n)]
    least = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in links[k] if j not in seen and not seen.add(j)]
        ids = [rows[k]["vec_id"] for k in seen if rows[k]["vec_id"] is not None]
        least.append(min(ids) if ids else None)
    want = Counter((r["vec_id"], len(links[i]), least[i], r["vec_id"] is not None and r["vec_id"] == least[i]) for i, r in enumerate(rows))
    got = Counter(tuple(r) for r in caps.near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = lambda v, k: [x + 0.01 * k * (n == 3) for n, x in enumerate(v)]
    rows = [(1, a, 0), (1, b, 0), (2, near(a, 1), 0), (3, near(b, 1), 0), (4, near(b, 2), 0), (1, a, 1)]
    got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == Counter([(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (1, 0, 1)])
    rows = [(7, a, 0), (9, near(a, 1), 0), (9, b, 0), (8, near(b, 1), 0)]
    got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == Counter([(7, 1, 7), (9, 1, 7), (9, 1, 8), (8, 1, 8)])


def test_a_query_whose_id_repeats(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.1, 1.0])]
    got = collisions.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 4), (0, 2, 3)]


def test_no_vectors(vectors):
    assert caps.near_duplicates(vectors.limit(0)).collect() == [] and collisions.neighbours(vectors.limit(0)).collect() == []


def test_product_code_lists_all_that_exceeds():
    code = caps.Code(16, 200)
    x = caps.unit(np.random.default_rng(1).normal(size=(50, 16)))
    row, of = code.decode(x, 1.0)
    a, b = code.blocks
    y = x @ code.rotation
    total = (y[:, :8] @ a.T)[:, :, None] + (y[:, 8:] @ b.T)[:, None, :]
    assert set(zip(row.tolist(), of.tolist(), strict=True)) == {(i, j * len(b) + k) for i, j, k in np.argwhere(total >= 1.0 / 4 * np.sqrt(2)).tolist()}


@pytest.mark.parametrize("segment", [8192, 40])
def test_neighbours(vectors, segment, monkeypatch):
    monkeypatch.setattr(collisions, "SEGMENT", segment)
    rows = [r for r in vectors.collect() if fits(r["embedding"]) and r["vec_id"] is not None]
    got = collisions.neighbours(vectors, 10).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in {r["vec_id"] for r in rows if r["vec_id"] % 10 == 0}:
        mine = next(r["embedding"] for r in rows if r["vec_id"] == q)
        best = sorted(((-cosine(mine, r["embedding"]), r["vec_id"]) for r in rows if r["vec_id"] != q and len(r["embedding"]) == len(mine)))[:5]
        found = sorted(by_query.get(q, []))
        assert [k for k, _, _ in found] == list(range(1, len(best) + 1))
        total += len(best)
        hit += sum((Counter(i for _, i in best) & Counter(i for _, i, _ in found)).values())
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
    assert hit >= 0.9 * total


def test_equal_neighbours_come_by_id(vectors):
    got = collisions.neighbours(vectors.where("vec_id >= 1000 and vec_id < 1030"), 10).where("query_id = 1010").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1000, 1001, 1002, 1003, 1004]


def test_urls(spark):
    cases = {
        "http://Example.COM/en/1?x": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://a.www.example.com/en/z#y": ("a.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/esp": ("x.net", "/esp", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://ads-track.example.org/": ("ads-track.example.org", "/", None, "block"),
        "no scheme.com/": ("", "", None, "allow"),
        "a://b://c.com/d": ("b:", "//c.com/d", None, "allow"),
        "://x.com/é\nz": ("x.com", "/é\nz", "com/", "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(k if k else None, u, "h", "h") for k, u in enumerate(cases)], "page_id long, url string, host string, verdict string")
    got = [tuple(r)[1:5] for r in urls.judged(df).collect()]
    assert got == list(cases.values())
    assert urls.judged(df.limit(0)).collect() == []
    assert urls.judged(df, (), ()).where("verdict <> 'allow' or rule is not null").count() == 0
    assert urls.judged(df, (urls.site("block", "example.com/E"),), ()).where("rule is not null").count() == 0


def test_rules_stand_under_their_rarest_token(spark):
    df = spark.createDataFrame([(["com", "example", "en"],), (["com", "example"],), (["com"],)], "tokens array<string>")
    assert urls.index(df, (urls.site("block", "example.com/en/"), urls.site("block", "example.com/e"), urls.site("allow", "com/"))) == {"en": [0], "example": [1], "com": [2]}


def test_chat(spark):
    said = ["\\### Assistant: </turn> ok", "<|end|>\n<|turn:assistant|>\n", "\\<|", "<", "|", "\\", "", None, "a\nb", "<\\|", "é" * 70_000]
    rows = [(1, k, ("user", "assistant")[k % 2], t, "x") for k, t in enumerate(said)]
    rows += [(2, 0, "system", "s", ""), (2, 1, "user", "u", ""), (2, 1, "user", "u", ""), (None, None, None, None, None), (3, 5, "<|odd\\", "o", ""), (4, 0, "x|>\ny", "|>", ""), (4, 1, "<", "<|turn user |>\n", ""), (4, 2, " |>\n", "|", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    want = {}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        learnt = "".join(t for role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        want[c] = (len(turns), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for got in (chat.formatted_and_read(df), chat.read_back(chat.segments(df))):
        assert {r["conv_id"]: tuple(r)[1:5] for r in got.collect()} == want
    ok = {r["conv_id"]: r["ok"] for r in chat.segments(df).groupBy("conv_id").agg(F.min("ok").alias("ok")).collect()}
    assert ok == {1: True, 2: False, None: False, 3: False, 4: False}
    assert chat.formatted_and_read(df.limit(0)).collect() == []


def test_control_strings_occur_only_where_the_template_puts_them(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|end|><|<|turn:")], "conv_id long, turn long, role string, text string")
    assert "".join(r["text"] for r in chat.segments(df).orderBy("seq").collect()).count("<|") == 2


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (1100, 900)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 900 for k in (900, *range(1000, 1200))}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = common.table(spark, small, "documents")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, small), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    packed = corpus_pipeline.run(spark, small)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_every_query_is_registered():
    assert sorted(Q.queries(), key=lambda n: (len(n.split("_")[0]), n))[0].startswith("op1_")
    assert {n.split("_")[0] for n in Q.queries()} == {"pipeline", *(f"op{k}" for k in range(1, 14))}
    assert set(Q.oracle_sql()) <= set(Q.queries())


@pytest.mark.parametrize("exact", [20_000, 100])
def test_all_linked_pairs_are_found(spark, exact, monkeypatch):
    monkeypatch.setattr(caps, "EXACT", exact, raising=False)
    rng = np.random.default_rng(11)
    rows = []
    for dim in (8, 64):
        x = caps.unit(rng.normal(size=(800, dim)))
        y = rng.normal(size=x.shape)
        y = caps.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
        rows += [(len(rows) + k, v.tolist(), 1) for k, v in enumerate(np.concatenate((x, 0.9305 * x + np.sqrt(1 - 0.9305**2) * y)))]
    got = {r["vec_id"]: r["n_links"] for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for dim, start in ((8, 0), (64, 1600)):
        v = caps.unit(np.array([r[1] for r in rows[start : start + 1600]]))
        assert [got[start + k] for k in range(1600)] == ((v @ v.T >= 0.93).sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("dim, largest", [(64, 50_000), (64, 200_000), (16, 200_000)])
def test_codes_hold_the_miss_rate(dim, largest):
    height, directions, codes = caps.plan(largest, dim)
    rng = np.random.default_rng(3)
    x = caps.unit(rng.normal(size=(2000, dim)))
    y = rng.normal(size=x.shape)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * caps.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    met = np.zeros(len(x), dtype=bool)
    for k in range(codes):
        code = caps.Code(dim, directions, k)
        a, b = ({*zip(*(c.tolist() for c in code.decode(v, height)), strict=True)} for v in (x, y))
        met[[i for i, _ in a & b]] = True
    assert met.all()


def test_small_labels_go_to_filters_too(spark, monkeypatch):
    """No size of a label switches the filters off."""
    asked = []
    plan = caps.plan
    monkeypatch.setattr(caps, "plan", lambda largest, dim: asked.append((largest, dim)) or plan(largest, dim))
    rows = [(k, [1.0, 0.01 * k, 0.0, 0.0], 0) for k in range(6)]
    got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert asked == [(6, 4)] and {(r["n_links"], r["component_id"]) for r in got} == {(5, 0)}
