"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, chat, codebooks, collisions, infill, licences, packing, pieces, quality, recompress, simhash, sql, transducer, urls
from .common import table

#: Where the vocabulary files lie; the files themselves are not part of this repository.
PIECES, BYTES, LOWER = "piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(BYTES))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.neighbours(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digests(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_and_read(chat.with_probe(table(spark, sf_dir, "conversations")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.counted(table(spark, sf_dir, "documents"), vocabulary(LOWER))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_license_scan,
        op2_simhash_near_dedup,
        op3_embedding_near_dedup,
        op4_sentencepiece,
        op5_packing,
        op6_url_filter,
        op7_nearest,
        op8_quality,
        op9_substring_dedup,
        op10_chat_format,
        op11_vector_codes,
        op12_token_counts,
        op13_fill_in_middle,
    )
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return sql.ALL
