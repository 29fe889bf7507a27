"""From raw documents to token ids: language, exact copies, near copies, the mix of sources, pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, langid, minhash, mixing, sentencepiece_codec

#: Vocabulary of the last stage.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (null and empty texts too), or whose n-grams are too little like those of any
    language learnt from the rows with a label. If no row has one, nothing can be told and all stay. Each row is judged
    by its text alone, so rows that are repeated, share an id or have none are judged alike."""
    return langid.accepted(docs, langid.fit(spark, docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; null counts as empty text, a null id as the smallest."""
    return exact_dedup.drop_duplicates(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; rows without words or
    without an id all stay."""
    return minhash.drop_near_duplicates(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, and cut where it takes them in part. Rows without words
    go; a null source is a source of its own; rows that share an id, or have none, are drawn each for itself."""
    return mixing.repeated(spark, docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 and exact (the ids decode to the text), a row for each row; null text has no
    pieces."""
    return sentencepiece_codec.round_trip(docs, PIECES)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pieces", pieces)]
ORACLE_SQL = None  # the language model and the draws of the mix aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs.select(F.col("doc_id"), "n_tokens", "ids", "ids_crc32", "exact")
