"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (bpe, fertility, impacts, jaccard, language, licences, lines, manifest, neighbours, oracle, packing,
               resampling, targeting, toxicity)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, d).select("doc_id", "text"))


def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    held_out = language.fold(F.col("doc_id"), 3) == 1
    model = language.fit(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    held_out = language.fold(F.col("id"), 4) == 2
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    model = toxicity.train(docs, labels.filter(~held_out))
    return toxicity.predict(docs.withColumn("held_out", held_out), model).select(
        F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op4_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, d))


def op5_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_pieces(documents(spark, d), word_vocabulary()))


def op6_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    share = labels.agg(F.avg("good")).first()[0] or 0.0  # as many as the labels call good
    return resampling.resample(docs, resampling.marked(docs, labels), share, key="id").select(
        F.col("id").alias("doc_id"), "log_weight", "gumbel_key", "sampled")


def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return fertility.quality_rules(
        documents(spark, d).select("doc_id", "lang", "text"), public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "token_entropy", "rejected_by")


def op8_bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    coded = bpe.encode(documents(spark, d).select("doc_id", "text"), word_vocabulary(), decoded=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("token_bytes", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_license_scans(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan(documents(spark, d).select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_embedding_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"))


def op11_exact_top_k_search(spark: SparkSession, d: str) -> DataFrame:
    return impacts.top_k(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op12_target_resampling(spark: SparkSession, d: str) -> DataFrame:
    return targeting.resample_to_target(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    less = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.manifest(
        documents(spark, d), "source", "doc_id", ("doc_id", "source", "lang", "n_chars", "text"), {"text": less})


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_license_scans": op9_license_scans,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_exact_top_k_search": op11_exact_top_k_search,
    "op12_target_resampling": op12_target_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": oracle.JACCARD,
    "op10_embedding_near_dedup": oracle.NEAR_VECTORS,
    "op11_exact_top_k_search": oracle.TOP_K,
    "op12_target_resampling": oracle.TARGET_RESAMPLING,
    "op13_merkle_manifest": oracle.MANIFEST,
}
