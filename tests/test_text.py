from pyspark.sql import functions as F

from brightshelf.functions import text as X


def values(spark, texts, *exprs):
    return [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(*exprs).collect()]


def test_normalize(spark):
    got = values(spark, ["  Ёлка,  WH-1000XM5! ", "", None, "a_b\tc"], X.normalize("t"))
    assert got == [("елка wh-1000xm5",), ("",), (None,), ("a_b c",)]


def test_tokens_with_hyphens_are_order_dependent(spark):
    cases = {
        "5w-30 5w oil": ["5w-30", "5w30", "5w", "30", "5w", "oil"],
        "5w 5w-30": ["5w", "5w-30", "5w30", "30"],
        "-- a-b wh-1000xm5": ["--", "a-b", "ab", "wh-1000xm5", "wh1000xm5", "wh", "1000xm5"],
        "red red": ["red", "red"],
        "и на x": [],
        "": [],
    }
    assert values(spark, cases, X.tokenize("t")) == [(v,) for v in cases.values()]


def test_tokens_of_many_texts(spark):
    import random

    from brightshelf.functions import words as W

    def slow(text):
        out = []
        for w in (w for w in text.split() if w not in W.STOP_WORDS):
            forms = [w.replace("-", "")] + [p for p in w.split("-") if p not in W.STOP_WORDS] if "-" in w else []
            out += [w] if len(w) > 1 else []
            for f in forms:
                out += [f] if len(f) > 1 and f not in out else []
        return out

    draw = random.Random(7)
    pieces = ["a", "b", "ab", "-", "-", "и", "на", "5w", " ", " ", " ", "x-y", "для"]
    texts = ["".join(draw.choices(pieces, k=draw.randrange(60))) for _ in range(1000)]
    assert values(spark, texts + [None], X.tokenize("t")) == [(slow(t),) for t in texts] + [(None,)]


def test_layouts(spark):
    assert values(spark, ["ghbdtn"], X.convert_layout("t"), X.layout_variants("t")) == [("привет", ["привет"])]
    assert values(spark, ["привет"], X.layout_variants("t"), X.wrong_layout("t")) == [(["ghbdtn"], True)]
    assert values(spark, ["123"], X.layout_variants("t")) == [([],)]


def test_ngrams_of_short_texts(spark):
    assert values(spark, ["abcd", "ab", ""], X.ngrams("t")) == [(["abc", "bcd"],), (["ab"],), ([""],)]
    assert values(spark, ["ab"], X.padded_ngrams("t"), X.padded_ngrams("t", prefix_only=True)) == [(["__a", "_ab", "ab_", "b__"], ["__a", "_ab"])]


def test_stems_keep_two_characters(spark):
    assert values(spark, ["ноутбуки", "кот", "наушниками"], X.stem("t")) == [("ноутбук",), ("кот",), ("наушник",)]


def test_transliteration(spark):
    assert values(spark, ["schema"], X.transliterate("t")) == [("щэма",)]
    assert values(spark, ["найке", "Nike", "a1"], X.spelling_variants("t")) == [(["найке", "najqе"],), (["Nike", "никэ"],), (["a1"],)]


def test_prices(spark):
    got = values(spark, ["1 299,90", "", None, "1.299,90", "x"], X.parse_price("t"))
    assert got == [(1299.9,), (0.0,), (0.0,), (None,), (0.0,)]


def test_highlight_runs_token_after_token(spark):
    assert values(spark, ["Red ring"], X.highlight("t", ["red", "e"])) == [("<<em>e</em>m>R<em>e</em>d</<em>e</em>m> ring",)]


def test_money_and_html(spark):
    assert values(spark, ["1234.5"], X.money(F.col("t").cast("double"))) == [("1 234,50",)]
    assert values(spark, ["<b>'&\""], X.escape_html("t")) == [("&lt;b&gt;&#39;&amp;&quot;",)]
