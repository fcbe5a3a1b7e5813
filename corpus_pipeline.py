"""A training corpus in five stages: language, exact copies, near copies, mixture, tokens.

Every stage is written as Parquet to the folder that all executors share and read again by the next one. Texts whose
language the model can't tell go in the first stage: null and empty ones, those without a letter, and those whose
runner-up is close; a null lang becomes the predicted one. An empty table stays empty; extra columns are carried to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm import ecoc_langid, es_mixing, exact_dedup, prefix_bpe, simhash_cover
from heronry.llm.common import cut, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ecoc_langid.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_cover.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return es_mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of every document, repeats included."""
    return prefix_bpe.tokens(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # learned languages, XXH64 fingerprints and byte pairs have no SQL form; tests hold it against plain Python
