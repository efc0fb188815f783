"""From raw documents to packed training sequences: quality, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from brightshelf.llm import alike, packing, quality, recompress
from brightshelf.llm.common import completed, table

#: The tokenizer's file; its place is a parameter of the machine, not of this repository.
VOCABULARY = "byte_bpe_50k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return alike.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 and more words go where an earlier document has them; documents stay."""
    return recompress.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("repeats", cut_repeats), ("packing", pack)]

#: No SQL expresses tokenization or the classifier; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        done = completed(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)
