"""Spelling: dictionaries, deletion index, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

DISTANCE = 2


def dictionary(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, freq) of the words of 3 characters or more."""
    cleaned = F.regexp_replace(F.lower(column), r"(?U)[^\w]", " ")
    words = texts.select(F.explode(F.split(cleaned, r"(?U)\s+")).alias("word")).where(F.length("word") >= 3)
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def _without_one(words: Column) -> Column:
    """Every string that lacks one character of one of these."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.filter(F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), of))), lambda w: w != "")


def with_deletes(word: Column | str, distance: int = DISTANCE) -> Column:
    """A word and all that is left of it without up to ``distance`` characters."""
    level = F.array(X.col(word))
    every = level
    for _ in range(distance):
        level = _without_one(level)
        every = F.concat(every, level)
    return F.array_distinct(every)


def deletes(words: DataFrame) -> DataFrame:
    """(del, word): the deletion index of ``words`` (word, ...)."""
    return words.select(F.explode(with_deletes("word")).alias("del"), "word")


def candidates(misspelt: DataFrame, index: DataFrame) -> DataFrame:
    """(word, candidate, distance): known words that share a deletion with ``misspelt`` (word) and are near enough."""
    own = misspelt.select("word").distinct().select("word", F.explode(with_deletes("word")).alias("del"))
    pairs = own.join(index.withColumnRenamed("word", "candidate"), "del").select("word", "candidate").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "candidate")).where(F.col("distance") <= DISTANCE)


def corrections(misspelt: DataFrame, index: DataFrame, words: DataFrame) -> DataFrame:
    """(word, correction, confidence): the candidate of the highest freq / (distance + 1), ties to the nearer, then the smaller;
    a word without candidates stays, at confidence 0.5."""
    scored = candidates(misspelt, index).join(words.withColumnRenamed("word", "candidate"), "candidate", "left")
    order = [F.desc(F.coalesce("freq", F.lit(1)) / (F.col("distance") + 1)), F.asc("distance"), F.asc("candidate")]
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where("n = 1")
    out = misspelt.select("word").distinct().join(best.select("word", "candidate", "distance"), "word", "left")
    confidence = F.coalesce(1.0 - F.col("distance") / (DISTANCE + 1), F.lit(0.5))
    return out.select("word", F.coalesce("candidate", "word").alias("correction"), confidence.alias("confidence"))


def check(queries: DataFrame, words: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query_id, corrected, confidence, was_corrected) of ``queries`` (query_id, q): words of 3 characters or more that are not
    known are corrected; the confidence is the mean of its words'."""
    index = deletes(words) if index is None else index
    cleaned = F.regexp_replace(F.lower("q"), r"(?U)[^\w]", " ")
    tokens = queries.select("query_id", F.posexplode(F.filter(F.split(cleaned, r"(?U)\s+"), lambda w: w != "")).alias("pos", "word"))
    known = words.select("word", F.lit(True).alias("known"))
    marked = tokens.join(known, "word", "left").withColumn("fine", F.coalesce("known", F.lit(False)) | (F.length("word") < 3))
    fixed = corrections(marked.where("not fine"), index, words)
    rows = marked.join(fixed, "word", "left")
    rows = rows.withColumns({"w": F.when(F.col("fine"), F.col("word")).otherwise(F.col("correction")), "c": F.when(F.col("fine"), 1.0).otherwise(F.col("confidence"))})
    ordered = F.array_sort(F.collect_list(F.struct("pos", "w")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["w"]), " ").alias("corrected"), F.avg("c").alias("confidence"), F.max(F.col("w") != F.col("word")).alias("was_corrected"))


def closest_words(tokens: DataFrame, words: DataFrame, distance: int = DISTANCE, shortest: int = 4) -> DataFrame:
    """(token, fixed): tokens of 4 characters or more that are not known become the closest word at distance 2 or less, ties to
    the smaller. Candidates come by the deletion index, which finds every word within the distance."""
    unknown = tokens.select(F.col("token").alias("word")).distinct().where(F.length("word") >= shortest).join(words.select("word"), "word", "left_anti")
    best = candidates(unknown, deletes(words.select("word"))).groupBy("word").agg(F.min(F.struct("distance", "candidate")).alias("b"))
    return tokens.join(best.withColumnRenamed("word", "token"), "token", "left").withColumn("fixed", F.coalesce("b.candidate", "token")).drop("b")
