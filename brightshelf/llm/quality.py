"""Quality by regularised quadratic discriminant analysis over statistics of the text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_small, document_batches, stored

#: Share of a class covariance that comes from the pooled one, and of the result that is its mean variance times I.
POOLED, RIDGE = 0.2, 0.02
#: Labelled documents that the discriminant is fitted to, about: of more, those of the smallest hashes of their ids.
LABELLED = 16_384
#: A text is kept from this score on.
THRESHOLD = 0.5

_class = np.zeros((256, 8))
for _k, _of in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\f\v", b"\n", b".,;:'\"?()-", b"#$%&*+/<=>@[\\]^_`{|}~!")):
    _class[list(_of), _k] = 1
_class[128:, 7] = 1
_symbols = frozenset(np.flatnonzero(_class[:, 6]).tolist())

STATISTICS = ("words", "chars", "upper", "digits", "symbols", "punctuation", "high", "lines", "word_length", "longest", "distinct", "stutter", "same_lines", "odd_words", "short_words", "entropy")


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one text: logarithms of counts, square roots of shares. Null is the empty text."""
    data = (text or "").encode("utf-8", "replace")
    tally = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    lower, upper, digits, space, breaks, points, symbols, high = (tally @ _class).tolist()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, m, chars = max(len(words), 1), max(len(lines), 1), max(len(data), 1)
    letters = max(lower + upper + high, 1)
    visible = max(chars - space - breaks, 1)
    counts = tally[tally > 0]
    share = counts / max(counts.sum(), 1)
    lengths = [*map(len, words)] or [0]
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    odd = sum(x[-1] in _symbols for x in words)
    return np.array(
        [
            np.log1p(len(words)), np.log1p(len(data)), (upper / letters) ** 0.5, (digits / visible) ** 0.5, (symbols / visible) ** 0.5, (points / visible) ** 0.5,
            (high / letters) ** 0.5, np.log1p(len(lines)) - 0.5 * np.log1p(len(words)), np.log1p(sum(lengths) / n), np.log1p(max(lengths)),
            np.log((len(set(words)) + 1) / (n + 1)) / np.log(n + 2), (stutter / n) ** 0.5, (1 - len(set(lines)) / m) ** 0.5 if lines else 0.0, (odd / n) ** 0.5,
            (sum(x <= 3 for x in lengths) / n) ** 0.5, float(-(share * np.log(share)).sum()) if len(counts) else 0.0,
        ]
    )


def statistics_of(text: str) -> Column:
    return F.pandas_udf(lambda texts: pd.Series([statistics(x) for x in texts]), "array<double>")(text)


@dataclass(frozen=True)
class Discriminant:
    """Per class: prior, mean, the inverse of the covariance's Cholesky factor, and its log-determinant."""

    classes: tuple
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of x."""
        z = (x - self.centre) / self.scale
        density = []
        for prior, mean, inverse, log_det in self.classes:
            d = (z - mean) @ inverse.T
            density.append(np.log(prior) - 0.5 * (d * d).sum(axis=1) - 0.5 * log_det)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))

    def of_text(self, text: str) -> Column:
        return F.pandas_udf(lambda texts: pd.Series(self.score(np.array([statistics(x) for x in texts])) if len(texts) else []), "double")(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of the documents whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def known(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the documents that are learnt: about LABELLED of them at most.

    Label rows without a doc_id or quality, or of a held-out document, are left out; a document with several labels has the
    one most of them give, 1 in a tie.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    found = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    share = LABELLED / max(found.count(), LABELLED)
    return stored(found.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))), "labelled")


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), fitted to known() labels.

    Each class is known by the sums and products of its rows, which Spark adds up. With too few rows of a class it takes
    the pooled covariance; with none at all, both classes are alike, so every text scores the prior.
    """
    chosen = attach_small(document_batches(docs).select("doc_id", "text"), known(labels), ["doc_id"]).where("quality is not null")
    stats = chosen.select("quality", statistics_of("text").alias("stats"))
    rows = stats.select("quality", F.expr("concat(array(1D), stats)").alias("x"))
    k = len(STATISTICS) + 1
    product = F.expr("flatten(transform(x, a -> transform(x, b -> a * b)))")
    sums = rows.select("quality", F.posexplode(product).alias("at", "v")).groupBy("quality", "at").agg(F.sum("v").alias("v")).collect()
    grams = np.zeros((2, k, k))
    for r in sums:
        grams[r["quality"], r["at"] // k, r["at"] % k] = r["v"]
    n = grams[:, 0, 0]
    if not n.sum():
        grams[1, 0, 0] = n[1] = 1.0
    total = grams.sum(axis=0)
    centre = total[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / n.sum() - centre**2, 0))
    scale[scale < 1e-6] = 1.0
    means, scatters = [], []
    for g, m in zip(grams, n, strict=True):
        mean = g[0, 1:] / m if m else centre
        scatters.append(((g[1:, 1:] - m * np.outer(mean, mean)) / np.outer(scale, scale)))
        means.append((mean - centre) / scale)
    pooled = sum(scatters) / max(n.sum(), 1)
    classes = []
    for mean, scatter, m in zip(means, scatters, n, strict=True):
        own = scatter / m if m > k else pooled
        cov = (1 - POOLED) * own + POOLED * pooled
        cov = (1 - RIDGE) * cov + RIDGE * max(np.trace(cov) / (k - 1), 1e-6) * np.eye(k - 1)
        factor = np.linalg.cholesky(cov)
        classes.append(((m + 1) / (n.sum() + 2), mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(classes), centre, scale)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; other columns are not read).

    Null and empty texts are scored like any other, by the statistics of no words. Rows with a null doc_id are scored and
    not held out. Repeated rows are scored alike.
    """
    model = fit(docs, labels)
    scored = document_batches(docs).select("doc_id", held_out().alias("held_out"), model.of_text("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns."""
    return document_batches(docs).where(fit(docs, labels).of_text("text") >= THRESHOLD)
