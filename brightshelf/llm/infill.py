"""Fill-in-the-middle arrangements of documents, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text is cut into: runs of letters, and every other code point by itself.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, those that are arranged; of a hundred of these, those whose suffix comes first.
ARRANGED, SUFFIX_FIRST = 90, 20
#: Digits of the numbers that are drawn from a hash.
DIGITS = 8


def _drawn(key: Column, k: int) -> Column:
    """The k-th number of a document: some hexadecimal digits of its hash."""
    return F.conv(F.substring(key, 1 + DIGITS * k, DIGITS), 16, 10).cast("long")


def arranged(docs: DataFrame, seed: int = 1, rate: int = ARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` (doc_id, text; other columns are not read) with n, form, prefix_chars, middle_chars and output.

    A text of n units is cut at two places that the SHA-256 of ``seed:doc_id`` names, so a run of letters is never cut.
    form is plain (the text as it is), psm (prefix, suffix, middle, each after its mark) or spm (suffix, prefix, middle).
    Plain are texts that are empty or hold a mark, and those beyond ``rate`` of a hundred. Null texts are empty ones; of a
    null doc_id the hash is that of ``seed:``. Rows are independent: repeated rows get equal results, and nothing is
    shuffled. prefix_chars and middle_chars count code points and are null in plain texts.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    units = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), key.alias("key"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    n = F.size("units").cast("long")
    form = F.when((F.col("text") == "") | marked | (_drawn(F.col("key"), 2) % 100 >= rate), "plain").when(_drawn(F.col("key"), 3) % 100 < suffix_first, "spm").otherwise("psm")
    places = [_drawn(F.col("key"), k) % (n + 1) for k in (0, 1)]
    cut = units.select("doc_id", "text", "units", n.alias("n"), form.alias("form"), F.least(*places).cast("int").alias("low"), F.greatest(*places).cast("int").alias("high"))
    joined = lambda begin, end: F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, end - begin), ""))
    low, high, size = F.col("low"), F.col("high"), F.size("units")
    parts = cut.select("doc_id", "text", "n", "form", joined(F.lit(0), low).alias("prefix"), joined(low, high).alias("middle"), joined(high, size).alias("suffix"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    return parts.select("doc_id", "n", "form", *(F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")), output.alias("output"))


def restored(arrangements: DataFrame) -> DataFrame:
    """Adds ``text`` to ``arrangements`` (form, output, ...): what the output was made of, found by its marks alone.

    No arranged text holds a mark, so each of the three marks of an output is where it was put. An output whose marks are
    not those of its form gives null.
    """
    part = lambda k: F.get("parts", F.lit(k))
    psm, spm = (F.concat(F.lit("^"), F.concat_ws("", *(F.lit(f"{m}(?s:.*)") for m in order))) for order in ((PREFIX, SUFFIX, MIDDLE), (SUFFIX, PREFIX, MIDDLE)))
    found = arrangements.withColumn("parts", F.when(F.col("form") != "plain", F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)))
    whole = F.size("parts") == 4
    text = (
        F.when(F.col("form") == "plain", F.col("output"))
        .when((F.col("form") == "psm") & whole & F.rlike("output", psm), F.concat(part(1), part(3), part(2)))
        .when((F.col("form") == "spm") & whole & F.rlike("output", spm), F.concat(part(2), part(3), part(1)))
    )
    return found.withColumn("text", text).drop("parts")


def digests(docs: DataFrame) -> DataFrame:
    """Of each arrangement of ``docs``: doc_id, n, form, prefix_chars, middle_chars and SHA-256 of the output and of the text that
    is read back from it."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    back = restored(arranged(docs)).withColumnRenamed("text", "restored")
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
