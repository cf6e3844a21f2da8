"""The operators as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import (
    conversation_repair,
    fingerprints,
    html_text,
    language_id,
    mixing,
    near_dedup,
    quality,
    sanitising,
    secret_scan,
    sentencepiece_scan,
    substring_dedup,
    warc,
    whitening,
)
from tablewright.llm.oracles import ORACLES as SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.withColumn("held_out", F.crc32(name) % 5 == 0)
    model = language_id.train(docs.where(~F.col("held_out")))
    found = language_id.identified(docs.select("doc_id", "text"), model)
    return found.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).select(
        "doc_id", "held_out", "lang_pred", "score")


def op2_weighted_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    turns = mixing.schedule(docs)
    turns = turns.withColumn("row", F.struct("row.doc_id"))
    return mixing.taken_words(turns).select("row.doc_id", "size", "source_size", "target", "taken")


def op3_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encoded(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", "ids", "round_trip")


def op4_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs, carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op7_rolling_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("intervals", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.shown("fingerprint").alias("fingerprint"),
        fingerprints.shown("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return secret_scan.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(spans).alias("spans"),
    )


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector and component; deviation is null where it exceeds a long (from some millions of rows)."""
    found = whitening.whitened(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("*", F.posexplode("whitened").alias("at", "score")).select(
        "row.vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"),
        F.col("score").alias("whitened"), F.get("explained", "at").alias("explained"), "identity_error",
    )


def op12_disclosure_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 4)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return sanitising.found_spans(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "row.doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(sanitising.KINDS[:4])],
        F.sha2(sanitising.listed(base), 256).alias("base_sha256"), sanitising.listed(spans).alias("spans"),
    )


def op13_auction_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repairs = conversation_repair.repaired(_table(spark, sf_dir, "conversations"), damage=True)
    return conversation_repair.audited(repairs).withColumnRenamed("conv", "conv_id")


QUERIES = {
    "op1_ngram_language_id": op1_ngram_language_id,
    "op2_weighted_fair_mixing": op2_weighted_fair_mixing,
    "op3_sentencepiece_scan": op3_sentencepiece_scan,
    "op4_seekable_warc": op4_seekable_warc,
    "op5_divergence_quality": op5_divergence_quality,
    "op6_text_density": op6_text_density,
    "op7_rolling_substring_dedup": op7_rolling_substring_dedup,
    "op8_imatch_fingerprints": op8_imatch_fingerprints,
    "op9_entropy_secrets": op9_entropy_secrets,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_jacobi_davidson_whitening": op11_jacobi_davidson_whitening,
    "op12_disclosure_sanitising": op12_disclosure_sanitising,
    "op13_auction_conversation_repair": op13_auction_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {name: sql for name, sql in SQL.items() if name in QUERIES}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
