"""Stages of the corpus pipeline: (spark, docs, sf_dir) to documents, the last one to packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import stored
from . import jaccard, language, lines, packing, toxicity
from .queries import word_vocabulary

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the codes decide on; others have no letters or lie between languages."""
    model = language.fit(docs)
    return language.predict(docs, model).filter(
        (F.col("lang_pred") != language.UNDETERMINED) & ~F.col("ambiguous")).select(*DOCUMENT)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic; the model learns from labels of documents that are here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    model = toxicity.train(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    return toxicity.predict(docs, model).filter("predicted = 0").select(*DOCUMENT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of passages; documents of which no word is left go."""
    cleaned = lines.dedup_lines(docs)
    some = ~F.col("text").rlike(r"^[\x20\x09-\x0D]*$")
    return (cleaned.filter((F.col("n_removed_lines") == 0) | F.col("text").isNull() | some)
            .withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*DOCUMENT))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of linked ones; rows are told apart by row, not by id."""
    rows = stored(docs.select(*DOCUMENT, F.monotonically_increasing_id().alias("_row")), "rows")
    later = jaccard.jaccard_components(rows, key="_row").filter("component_id < doc_id").select(F.col("doc_id").alias("_row"))
    return rows.join(later, "_row", "left_anti").select(*DOCUMENT)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, word_vocabulary()))
