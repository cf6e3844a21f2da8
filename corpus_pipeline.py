"""From raw documents to token ids: five stages, each written and read again.

    quality     documents that break a quality rule go
    near_dedup  of each group of near duplicates one document stays
    secrets     secrets in the texts are masked
    mix         sources are brought to their target weights, in training order
    tokens      texts become token ids

Near duplicates are judged here on shingles of five words at a similarity of 0.8.

All stages but the last return the columns of ``documents``.  A stage's output is a
Parquet table in the folder that ``spark.checkpoint.dir`` names, so a lost executor costs
tasks of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import common, mixing, near_dedup, quality, secret_scan, sentencepiece_scan


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; a null or empty text is rejected."""
    return quality.drop_low_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without an id stay."""
    return near_dedup.drop_near_duplicates(docs, width=5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in the text masked; n_chars follows the text."""
    return secret_scan.masked(docs, count_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order, a document repeated up to three times."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every row of the mix."""
    return sentencepiece_scan.encoded(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("tokens", tokenize),
]

#: SQL can't express the last stage; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
