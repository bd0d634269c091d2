"""The corpus pipeline: every stage takes effect on what its predecessor kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from voxsieve.llm import lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_the_other(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kinds = docs.dtypes
    seen = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == COLUMNS and docs.dtypes == kinds
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= seen
        if name == "line_dedup":
            # nothing is left to delete
            assert lines.dedup_lines(docs).agg(F.sum("n_removed_lines")).first()[0] == 0
        if name == "best_fit_packing":
            assert ids == {r["doc_id"] for r in before.collect()}
        seen = ids
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "toxicity", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]


def test_jaccard_stage_drops_rows_not_ids(spark):
    t, u = " ".join(f"t{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, t), (2, t), (2, u), (3, u + " q"), (4, "alone " + u[:20]), (4, "alone " + u[:20]), (None, t), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).coalesce(1)
    kept = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "").collect()]
    assert sorted(kept, key=repr) == sorted([(1, t), (2, u), (4, "alone " + u[:20]), (None, None)], key=repr)


def test_stages_of_nothing_and_of_nulls(spark, small):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words of a short text", "en", "s", 27)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() <= 3
        assert stage(spark, docs.filter("false"), small).count() == 0, name
