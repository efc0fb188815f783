import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice(["th", "er", "on", "é", "ß", "A", "nd"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words):
    """Texts with copies, near copies, shared passages, runs, blanks, one very long one, and nulls."""
    rng = random.Random(4)
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 12, 13, 14, 40, 120]))) for _ in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = list(base)
    for k in range(12):
        w = rng.choice(base).split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(rng.choice(base))
        out.append(f"{rng.choice(base)}\n{passage}\t{rng.choice(base)}")
    out += ["", None, " \t\n", "the " * 60, "x " + "the " * 40, "a b " * 30, "Q a b " * 20, "\x0b\x0c", "  two  spaces  ", "▁mark a▁b", "tab\t\r\nend ", "日本語 тест 🙂 e\u0301", "nul\x01x <|endoftext|> y"]
    out.append(" ".join(rng.choice(words) for _ in range(30_000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names the operators use themselves, repeated rows and a null id."""
    rows = [(k * 3 % 101 + 200 * (k * 3 // 101), t, "en", 1, "x", 7) for k, t in enumerate(texts)]
    rows += [rows[5], rows[17], (None, texts[3], None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, __block int, fp string, component_id long").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
