"""One query per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import features as feat, scores as sc, speech as sp, text as tx
from ..operators import (
    acoustics, align, contour, features, labels as lb, learning as ml, lexicon as lx, metrics as mt, ridge as rd, rollup as ru, scorer, segments as sg,
    splits as sp_)
from ..plans import directory as dr, pairs as pr, recordings as rec, training as tr
from ..settings import DEFAULTS, TOXIC_LABELS
from ..sources import media, results as res, tables as tb, transcripts as ts, tsv
from ..sources.scratch import scratch_dir, stored
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema])


def entries(df: DataFrame, key: str, column: str, name: str = "label", value: str = "score") -> DataFrame:
    return rounded(df.select(key, F.explode_outer(column).alias(name, value)))


# --- sources and sinks -------------------------------------------------------------------------

@query
def read_transcripts(spark, d):
    path = scratch_dir(spark, "transcripts")
    some = F.when(fx.doc_id() % 5 != 0, F.col("language")).alias("language")
    fx.transcripts(spark, d).select("file", "text", some, "segments").write.json(path)
    df = ts.read_transcripts(spark, path, one_per_file=False)
    return df.select("file", "language", "text", F.size("segments").cast("bigint").alias("n_segments"))


@query
def explode_segments(spark, d):
    return sg.explode_segments(fx.transcripts(spark, d)).select("file", "language", "seg_idx", "text")


@query
def read_labeled_csv(spark, d):
    path = scratch_dir(spark, "labeled")
    variant = F.pmod("row_id", F.lit(4)).cast("int")
    raw = F.when(F.col("label") == 1, F.array(*map(F.lit, ("1", "TRUE", " extremist ", "1.0")))[variant]).when(
        F.col("label") == 0, F.array(*map(F.lit, ("0", "no", "junk", "Non-Extremist")))[variant])
    tb.export_columns(fx.labeled(spark, d).select("row_id", "text", raw.alias("label")), ["row_id", "text", "label"], path)
    return tb.read_labeled_csv(spark, path)


@query
def union_tsv_dir(spark, d):
    path = scratch_dir(spark, "tsv")
    fx.write_tsv_files(spark, d, path)
    whole = tsv.union_tsv_dir(spark, path)
    return whole.select(
        F.col("row_id").cast("bigint").alias("row_id"), "text", F.col("label").cast("int").alias("label"), "lang")


@query
def read_annotations(spark, d):
    df = tb.read_annotations(spark, f"{d}/events.parquet")
    return rounded(df.groupBy(F.col("user_id").alias("comment_id")).agg(
        F.count("*").alias("n_annotations"), F.avg("value").alias("rating")))


@query
def media_manifest(spark, d):
    suffix = F.array(*map(F.lit, (".mp4", ".MP3", ".txt", "", ".wav", ".json")))[F.pmod("page_id", F.lit(6)).cast("int")]
    files = fx.table(spark, d, "pages").select(
        F.concat(F.regexp_replace("url", "[?#].*$", ""), suffix).alias("path"), "page_id")
    return media.media_manifest(files).select("page_id", "path", "file_type")


@query
def url_media_name(spark, d):
    df = fx.urls(spark, d).filter("url is not null")
    return df.withColumns(tx.url_media_name(F.col("url"))).select("page_id", "media_name", "extension", "result_name")


@query
def pair_feature_files(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    text = docs.select(F.concat(stem, F.lit("_multimodel.json")).alias("name"), "doc_id")
    heard = docs.filter("doc_id % 3 <> 0").select(F.concat(stem, F.lit("_intonation.json")).alias("name"))
    pairs = media.pair_feature_files(text, heard)
    toxic = fx.table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return features.stack_classes({
        1: pairs.join(toxic, "doc_id", "left_semi"), 0: pairs.join(toxic, "doc_id", "left_anti"),
    }).select("base", "text_file", "acoustic_file", "label")


@query
def write_results(spark, d):
    scored = rec.score_recordings(fx.transcripts(spark, d), fx.lexicon(spark), store=True)
    path = scratch_dir(spark, "results")
    documents = ru.json_envelope(scored.segments, scored.statistics, ["text", "extreme", "is_extremist"])
    res.write_results(documents, scored.statistics, path)
    summary = spark.read.option("header", True).option("escape", '"').csv(f"{path}/summary")
    stored = ts.reload_results(spark, f"{path}/documents", one_per_file=False, pattern="*.txt").select(
        "file", F.size("segments").alias("n_segments"))
    return summary.select(
        "file", F.col("total_segments").cast("bigint").alias("total_segments"),
        F.col("extremist_segments").cast("bigint").alias("extremist_segments"), "result",
    ).join(stored.groupBy("file").agg(F.sum("n_segments").alias("stored_segments")), "file")


@query
def export_columns(spark, d):
    path = scratch_dir(spark, "export")
    df = fx.labeled(spark, d).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    tb.export_columns(df, ["label", "text"], path, sep="\t", header=False)
    return spark.read.schema("label int, text string").options(sep="\t", quote='"', escape='"').csv(path)


@query
def dump_features(spark, d):
    path = scratch_dir(spark, "dump")
    rows = fx.labeled(spark, d).filter("label is not null").select(F.col("row_id"), "text", "label")
    engineered = tr.text_features(rows, fx.lexicon(spark))
    res.dump_features(engineered, path)
    schema = res.feature_dump(engineered).schema
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


@query
def split_parts(spark, d):
    parts = tb.split_parts(fx.table(spark, d, "orders"), "o_orderkey", 1000)
    return parts.groupBy("part").agg(
        F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query
def dead_letter(spark, d):
    planted = fx.table(spark, d, "events").withColumn(
        "props", F.when(F.pmod("event_id", F.lit(13)) == 0, F.expr("substring(props, 1, length(props) - 1)"))
        .otherwise(F.col("props")))
    good, bad = ts.dead_letter(
        planted, "props", T.StructType([T.StructField("k", T.LongType())]), F.col("event_id"), F.lit("event"))
    none = F.lit(None).cast("string")
    return good.select(F.col("event_id").cast("string").alias("file"), F.col("parsed.k").alias("k"),
                       none.alias("file_type"), none.alias("error_type"), none.alias("error_message")).unionByName(
        bad.select("file", F.lit(None).cast("bigint").alias("k"), "file_type", "error_type", "error_message"))


@query
def skip_existing(spark, d):
    inputs = fx.table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".mp4")).alias("file"))
    done = fx.table(spark, d, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".json")).alias("file"))
    return media.skip_existing(inputs, done)


@query
def run_summary(spark, d):
    status = F.when(F.col("label").isNull(), "skipped").when(F.col("n_chars") < 300, "failed").otherwise("processed")
    return ru.run_summary(fx.labeled(spark, d).withColumn("status", status))


@query
def reload_results(spark, d):
    path = scratch_dir(spark, "reload")
    df = fx.transcripts(spark, d).withColumn("n", fx.doc_id())
    df.select(
        F.when(F.col("n") % 6 != 0, F.lit(True)).alias("success"),
        F.when(F.col("n") % 11 != 0, F.transform("segments", lambda g: F.struct(
            g["start"].alias("start"), g["end"].alias("end"), g["text"].alias("text")))).alias("segments"),
        F.concat("file", F.lit("-result.json")).alias("filename")).write.json(path)
    return ts.reload_results(spark, path, one_per_file=False).select(
        "file", "valid", "error", F.coalesce(F.size("segments"), F.lit(0)).cast("bigint").alias("n_segments"))


# --- projections, filters ------------------------------------------------------------------------

@query
def validate_url(spark, d):
    outcome = fx.urls(spark, d).withColumn("v", tx.validate_url(F.col("url"))).withColumn(
        "w", tx.validate_url(F.col("url"), allow_empty=True))
    return outcome.select("page_id", "v.valid", "v.error", F.col("w.valid").alias("valid_or_empty"))


@query
def segment_validity(spark, d):
    df = fx.segs(spark, d)
    shrunk = df.withColumn("end_s", F.when(F.col("seg_idx") % 5 == 1, F.col("start_s") + 0.05)
                           .when(F.col("seg_idx") % 5 == 2, F.col("start_s")).otherwise(F.col("end_s")))
    return rounded(sg.segment_validity(shrunk).select("file", "seg_idx", "start_s", "end_s", "duration"))


@query
def timestamp_parts(spark, d):
    df = fx.segs(spark, d).withColumns({
        "a": tx.timestamp_parts(F.round("start_s", 3)), "b": tx.timestamp_parts(F.round("end_s", 3))})
    return df.select("file", "seg_idx", F.col("a.minute").alias("start_minute"), F.col("a.second").alias("start_second"),
                     F.col("a.text").alias("start_text"), F.col("b.text").alias("end_text"))


@query
def clean_text(spark, d):
    raw = F.when(F.col("doc_id") % 10 == 0, F.lit(" \n\t ")).otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    return fx.table(spark, d, "documents").select("doc_id", tx.clean_text(raw).alias("text")).filter("text is not null")


@query
def highlight_segments(spark, d):
    start = F.col("vec_id") * 1.5
    df = fx.acoustic(spark, d).withColumns(tx.highlight(
        F.col("overall_toxicity"), start, start + F.round("duration", 3), F.col("hate_target"),
        F.col("hate_target_confidence"), F.substring("emotion", 1, 3), F.col("emotion_score")))
    return rounded(df.select("vec_id", "alpha", "tooltip"))


@query
def transcript_quality_gate(spark, d):
    df = fx.vectors(spark, d).select("vec_id", (4 * fx.s(30)).alias("compression_ratio"),
                                     (-2 * fx.s(31)).alias("mean_logprob"), fx.s(32).alias("no_speech_prob"))
    return rounded(sg.transcript_quality_gate(df))


# --- scalar functions -----------------------------------------------------------------------------

@query
def text_proxies(spark, d):
    return rounded(tx.with_text_proxies(fx.table(spark, d, "documents")).select(
        "doc_id", "num_words", "num_chars", "caps_ratio", "punct_intensity", "avg_word_len"))


@query
def normalize_label(spark, d):
    raw = F.array(*map(F.lit, fx.MIXED_LABELS))[F.pmod("event_id", F.lit(len(fx.MIXED_LABELS))).cast("int")]
    df = fx.table(spark, d, "events").select("event_id", raw.alias("raw"))
    return df.select("event_id", tx.normalize_label(F.col("raw"), yes_no_letters=False).alias("train_label"),
                     tx.normalize_label(F.col("raw")).alias("fill_label"))


@query
def sigmoid_scores(spark, d):
    return entries(fx.model_outputs(spark, d), "vec_id", "model_outputs.toxic")


@query
def softmax_scores(spark, d):
    text = F.when(F.col("vec_id") % 10 == 0, F.lit("  ")).otherwise(F.lit("said"))
    df = fx.vectors(spark, d).withColumn("h", sc.softmax_scores(F.array(12 * fx.x(1), 12 * fx.x(2) - 1), text))
    return rounded(df.select("vec_id", "h.hate_score", "h.hate_label", "h.confidence"))


@query
def label_list_to_map(spark, d):
    df = fx.model_outputs(spark, d)
    listed = F.when(F.col("vec_id") % 8 != 0, F.transform(
        F.map_entries("model_outputs.target"), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("score"))))
    mapped = df.select("vec_id", sc.label_list_to_map(listed).alias("m"))
    return rounded(mapped.select("vec_id", F.explode_outer("m").alias("label", "score")))


@query
def merge_categories(spark, d):
    df = fx.model_outputs(spark, d).select("vec_id", sc.merge_categories(F.col("model_outputs")).alias("c"))
    return entries(df, "vec_id", "c", "category")


@query
def detect_issues(spark, d):
    return fx.scores(spark, d).select("vec_id", F.posexplode_outer(sc.issue_text(F.col("detected_issues"))).alias("pos", "issue")
        ).filter("issue is not null")


@query
def overall_toxicity(spark, d):
    return rounded(fx.scores(spark, d).select("vec_id", "overall_toxicity", "is_toxic"))


@query
def hate_target(spark, d):
    return rounded(fx.scores(spark, d).select("vec_id", "hate_target", "hate_target_confidence"))


@query
def top_emotion(spark, d):
    listed = F.when(F.col("vec_id") % 9 != 0, F.col("model_outputs.sentiment"))
    df = fx.model_outputs(spark, d).withColumn("e", sc.top_emotion(listed))
    return rounded(df.select("vec_id", "e.emotion", "e.emotion_score"))


@query
def normalize_emotion(spark, d):
    codes = {"view": "hap", "signup": "ANG", "error": "neu", "click": "calm", "purchase": "sad"}
    code = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])[F.col("event_type")]
    return fx.table(spark, d, "events").select("event_id", tx.normalize_emotion(code).alias("emotion"))


@query
def scrub_nonfinite(spark, d):
    n = F.pmod("event_id", F.lit(8))
    bad = (F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(float("inf"))).when(n == 2, F.lit(float("-inf")))
           .when(n == 3, F.lit(None).cast("double")).otherwise(F.col("value")))
    df = fx.table(spark, d, "events").withColumn("value", bad)
    return rounded(df.withColumns(feat.scrub_nonfinite(["value"])).select("event_id", "value"))


def _polar_docs(spark, d):
    return lx.lexicon_polarity(fx.table(spark, d, "documents"), fx.lexicon(spark))


@query
def fallback_scores(spark, d):
    df = fx.segs(spark, d)
    out = F.col("model_outputs")
    flat = {f"{m}_{k.lower()}": out[m][k] for m, k in (
        ("toxic", "severe_toxic"), ("toxic", "insult"), ("hate", "HATE"), ("hate", "NOT-HATE"),
        ("offensive", "offensive"), ("sentiment", "positive"))}
    return rounded(df.select("file", "seg_idx", "overall_toxicity", "is_toxic",
                             *[c.alias(n.replace("-", "_")) for n, c in flat.items()]))


@query
def synthesize_intonation(spark, d):
    return rounded(fx.segs(spark, d).select(
        "file", "seg_idx", "emotion", "emotion_score", "duration", "f0_mean", "f0_std", "f0_min", "f0_max", "f0_range",
        "f0_slope", "f0_final", "rms_mean", "rms_max"))


@query
def sarcasm_score(spark, d):
    return rounded(sp.with_sarcasm(fx.acoustic(spark, d)).select("vec_id", "sarcasm_probability", "sarcasm_pattern"))


@query
def sarcasm_discount(spark, d):
    df = sp.with_sarcasm(fx.acoustic(spark, d))
    cut = sp.sarcasm_discount(F.col("overall_toxicity"), F.col("sarcasm_probability"))
    return rounded(df.withColumns(cut).select("vec_id", "detected", "score", "confidence"))


def _heuristic(spark, d):
    return sp.with_intonation_heuristic(fx.acoustic(spark, d).withColumn("has_acoustic", F.col("vec_id") % 11 != 0))


@query
def intonation_heuristic(spark, d):
    return rounded(_heuristic(spark, d).select("vec_id", "heuristic_score", "heuristic_certainty", "heuristic_factors"))


@query
def adaptive_decision(spark, d):
    flag = sp.adaptive_decision(F.col("heuristic_score"), F.col("heuristic_certainty"))
    return rounded(_heuristic(spark, d).select(
        "vec_id", flag.alias("is_extremist"), F.col("heuristic_score").alias("extremist_probability")))


def _outcomes(spark, d, settings=DEFAULTS):
    v = F.col("vec_id")
    ready = fx.acoustic(spark, d).withColumns({
        "has_acoustic": v % 7 != 0,
        "model_available": v % 2 == 0,
        "model_probability": F.when((v % 2 == 0) & (v % 10 != 0), fx.s(33)),
        "model_threshold": F.lit(0.4),
        "overall_toxicity": F.when(v % 13 != 0, F.col("overall_toxicity")),
    })
    return sp.with_segment_outcome(ready, settings)


@query
def segment_outcome(spark, d):
    columns = ("vec_id", "extreme", "is_extremist", "extremist_probability", "heuristic_used", "heuristic_confidence")
    plain = _outcomes(spark, d).select(*columns, F.lit(False).alias("sarcasm_on"))
    sly = _outcomes(spark, d, replace(DEFAULTS, sarcasm_enabled=True)).select(*columns, F.lit(True).alias("sarcasm_on"))
    return rounded(plain.unionByName(sly))


def _rollup(spark, d):
    return rec.score_recordings(fx.transcripts(spark, d), fx.lexicon(spark)).statistics


@query
def verdict_message(spark, d):
    n = fx.doc_id()
    varied = _rollup(spark, d).withColumns({
        "toxic_segments": F.when(n % 3 == 0, F.lit(0)).when(n % 3 == 1, F.lit(1)).otherwise(F.col("total_segments")),
        "is_extremist_content": F.when(n % 4 == 1, F.lit(True)).when(n % 4 == 2, F.lit(False)),
    })
    return varied.select("file", ru.verdict_message().alias("result"))


@query
def multimodel_features(spark, d):
    extra = F.map_concat("categories", F.create_map(F.lit("custom_score"), F.lit(0.25)))
    return entries(feat.with_multimodel_features(fx.scores(spark, d), extra), "vec_id", "features", "feature", "value")


@query
def intonation_features(spark, d):
    df = fx.acoustic(spark, d).withColumn("emotion", F.when(F.col("vec_id") % 10 != 0, F.upper("emotion")))
    named = feat.intonation_features()
    return rounded(df.select("vec_id", *[c.alias(n) for n, c in named.items()]))


@query
def feature_matrix(spark, d):
    df = feat.with_multimodel_features(fx.scores(spark, d)).select("vec_id", "features")
    return rounded(features.feature_matrix(df, features.feature_names(df)))


@query
def slice_audio(spark, d):
    start, end = 6 * fx.s(40) - 1, 6 * fx.s(40) - 1 + 3 * fx.s(41)
    df = fx.vectors(spark, d).select("vec_id", sp.slice_audio(F.col("x"), start, end, 16).alias("y"))
    total = F.aggregate("y", F.lit(0.0), lambda a, v: a + v)
    return rounded(df.select("vec_id", F.size("y").cast("bigint").alias("n"), F.get("y", F.lit(0)).alias("first"), total.alias("total")))


@query
def rms_energy(spark, d):
    df = fx.vectors(spark, d).withColumn("e", sp.rms_energy(F.col("x"), 16, 4, 16))
    return rounded(df.select("vec_id", "e.rms_mean", "e.rms_max"))


@query
def json_envelope(spark, d):
    scored = rec.score_recordings(fx.transcripts(spark, d), fx.lexicon(spark), store=True)
    documents = ru.json_envelope(scored.segments, scored.statistics, ["text", "extreme", "is_extremist"])
    parsed = documents.withColumn("j", F.from_json(
        "document", "success boolean, isExtremist boolean, segments array<struct<seg_idx:int,text:string>>, "
                    "statistics struct<total_segments:bigint,language:string>, filename string"))
    return parsed.select(
        "file", "part", F.col("n_segments").cast("bigint").alias("n_segments"), F.col("j.success").alias("success"),
        F.col("j.isExtremist").alias("is_extremist"), F.element_at("j.segments", 1)["text"].alias("first_text"),
        F.element_at("j.segments", -1)["text"].alias("last_text"),
        F.col("j.statistics.total_segments").alias("total_segments"), F.col("j.statistics.language").alias("language"))


# --- joins -----------------------------------------------------------------------------------------

@query
def align_nearest(spark, d):
    parts = []
    for hourly in (False, True):
        left = fx.event_points(spark, d, "click", hourly)
        right = fx.event_points(spark, d, "purchase", hourly).withColumnsRenamed({"event_id": "right_idx", "mid": "right_mid"})
        parts.append(align.align_nearest(left, right, tolerance=21600.0).select(
            F.lit(hourly).alias("hourly"), F.col("file").alias("user_id"), "event_id", "right_idx", "distance"))
    return rounded(parts[0].unionByName(parts[1]), 3)


@query
def align_positional(spark, d):
    df = fx.segs(spark, d)
    heard = df.filter("num_words >= 4").select("file", "seg_idx", F.col("seg_idx").alias("heard_idx"), F.col("f0_mean").alias("heard_f0"))
    return rounded(align.align_positional(df.select("file", "seg_idx"), heard).select(
        "file", "seg_idx", "has_acoustic", "heard_idx", "heard_f0"))


@query
def lexicon_polarity(spark, d):
    return rounded(_polar_docs(spark, d).select("doc_id", "neg", "neu", "pos", "compound"))


@query
def lexicon_polarity_joined(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    return rounded(lx.lexicon_polarity(docs.union(docs.select(F.lit(None), "text")), fx.word_valences(spark, d)).select(
        "doc_id", "neg", "neu", "pos", "compound"))


@query
def broadcast_predictions(spark, d):
    df = fx.annotations(spark, d)
    groups = df.groupBy("comment_id").agg(F.avg("rating").alias("rating"), (F.avg("rating") >= 10).cast("int").alias("pred"))
    return rounded(lb.broadcast_predictions(df.select("comment_id", "note_id", "rating"), groups, "comment_id"))


def _filled(spark, d):
    pred = (F.col("avg_word_len") + 20 * F.col("punct_intensity") > 5.0).cast("int")
    return lb.fill_labels(fx.labeled(spark, d).withColumn("pred", pred), "label", "pred")


@query
def fill_labels(spark, d):
    return _filled(spark, d).select("row_id", "label", "pred", "label_filled")


@query
def compare_versions(spark, d):
    changed = _filled(spark, d).withColumn(
        "label_filled", F.when(F.col("row_id") % 9 == 0, 1 - F.col("label_filled")).otherwise(F.col("label_filled")))
    return rounded(align.compare_versions(
        fx.labeled(spark, d).select("row_id", "label"), changed, "row_id", "label", "label_filled", "pred"))


# --- aggregations -------------------------------------------------------------------------------------

@query
def transcript_stats(spark, d):
    return rounded(ru.transcript_stats(fx.segs_with_scores(spark, d, "overall_toxicity", "is_toxic")))


@query
def hate_stats(spark, d):
    df = fx.segs_with_scores(spark, d, "x").withColumn(
        "h", sc.softmax_scores(F.array(12 * fx.x(1), 12 * fx.x(2) - 1), F.col("text")))
    return rounded(ru.hate_stats(df.select("*", "h.*")))


def _frequency(spark, d):
    return ru.issue_frequency(fx.segs_with_scores(spark, d, "detected_issues").filter(~F.col("is_blank")))


@query
def issue_frequency(spark, d):
    mapped = ru.issue_frequency_map(_frequency(spark, d))
    return mapped.select("file", F.explode("issue_frequency").alias("category", "n"))


@query
def document_scores(spark, d):
    return rounded(rec.document_scores(fx.transcripts(spark, d), fx.lexicon(spark)))


@query
def recording_rollup(spark, d):
    return rounded(_rollup(spark, d).drop("result"))


@query
def file_prediction_rollup(spark, d):
    pairs = fx.segs_with_scores(spark, d, "overall_toxicity").select(
        "file", F.col("overall_toxicity").alias("extremist_probability"), (F.col("overall_toxicity") >= 0.4).alias("is_extremist"))
    return rounded(ru.file_prediction_rollup(pairs))


@query
def annotator_rollup(spark, d):
    return rounded(lb.annotator_rollup(fx.annotations(spark, d), "comment_id", "note_id"))


@query
def group_targets(spark, d):
    return rounded(lb.group_targets(fx.annotations(spark, d), lb.find_id_column(["comment_id", "rating"]), ["rating", "k"], "label"))


@query
def profile_columns(spark, d):
    orders = fx.table(spark, d, "orders").drop("o_orderdate")
    docs = fx.table(spark, d, "documents")
    return rounded(lb.profile_columns(orders, orders.columns).unionByName(lb.profile_columns(docs, docs.columns)))


@query
def class_balance(spark, d):
    return rounded(lb.class_balance(fx.table(spark, d, "labels"), "toxic"))


@query
def prediction_rates(spark, d):
    return rounded(lb.prediction_rates(_filled(spark, d), "label", "pred"))


@query
def labeling_progress(spark, d):
    log = fx.table(spark, d, "labels").select(
        F.when(F.col("toxic") == 1, "extremist").when(F.col("quality") == 1, "not_extremist").otherwise("skipped").alias("label"))
    return rounded(lb.labeling_progress(log, fx.table(spark, d, "documents")))


@query
def contour_summary(spark, d):
    series = fx.table(spark, d, "events").withColumn(
        "value", F.when(F.col("event_id") % 6 != 0, F.col("value")).otherwise(F.lit(float("nan"))))
    return rounded(contour.contour_summary(series, "user_id", "event_id", "value"), 5)


@query
def impute(spark, d):
    df = fx.annotations(spark, d).select("note_id", "rating", "kind")
    return rounded(lb.Imputer.fit(df, ["rating"], ["kind"]).transform(df))


@query
def standardize(spark, d):
    df = fx.vectors(spark, d).select("vec_id", *[fx.x(i).alias(f"d{i}") for i in range(1, 65)], F.lit(3.0).alias("flat"))
    columns = [f"d{i}" for i in range(1, 65)] + ["flat"]
    return rounded(lb.Standardizer.fit(df, columns).transform(df))


# --- windows, splits, metrics ----------------------------------------------------------------------------

@query
def stratified_split(spark, d):
    return sp_.stratified_split(fx.table(spark, d, "labels"), "doc_id", "toxic").select("doc_id", "toxic", "part")


@query
def kfold_assign(spark, d):
    df = fx.table(spark, d, "labels")
    plain = sp_.kfold_assign(df, "doc_id", None).select("doc_id", F.col("fold").alias("plain_fold"))
    return sp_.kfold_assign(df, "doc_id", "toxic").select("doc_id", "toxic", "fold").join(plain, "doc_id")


def _tied(spark, d):
    return fx.scored_labels(spark, d).withColumn("score", F.round("score", 2))


@query
def threshold_sweep(spark, d):
    a = mt.threshold_sweep(fx.scored_labels(spark, d), "score", "y").withColumn("variant", F.lit("exact"))
    return rounded(a.unionByName(mt.threshold_sweep(_tied(spark, d), "score", "y").withColumn("variant", F.lit("tied"))))


@query
def prevalence_threshold(spark, d):
    df = fx.scored_labels(spark, d).withColumn("y", F.when(F.col("vec_id") % 3 != 0, F.col("y")))
    return rounded(mt.prevalence_threshold(df, "score", "y").withColumn("quantile_over", F.lit("labelled")).unionByName(
        mt.prevalence_threshold(df, "score", "y", "unlabelled").withColumn("quantile_over", F.lit("unlabelled"))))


@query
def roc_auc(spark, d):
    a = mt.roc_auc(fx.scored_labels(spark, d), "score", "y").withColumn("variant", F.lit("exact"))
    return rounded(a.unionByName(mt.roc_auc(_tied(spark, d), "score", "y").withColumn("variant", F.lit("tied"))))


@query
def average_precision(spark, d):
    a = mt.average_precision(fx.scored_labels(spark, d), "score", "y").withColumn("variant", F.lit("exact"))
    return rounded(a.unionByName(mt.average_precision(_tied(spark, d), "score", "y").withColumn("variant", F.lit("tied"))))


@query
def segment_timeline(spark, d):
    return rounded(fx.segs(spark, d).select("file", "seg_idx", "start_s", "end_s"))


# --- sorts, limits, sets -------------------------------------------------------------------------------------

@query
def top_issues(spark, d):
    return ru.top_issues(_frequency(spark, d)).select("file", "rank", "category", "n")


@query
def head_rows(spark, d):
    return tb.head_rows(fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), 100, [F.col("doc_id")])


@query
def stack_classes(spark, d):
    df = fx.segs(spark, d).select("file", "seg_idx", "overall_toxicity", "f0_mean")
    odd = fx.doc_id() % 2 == 1
    return rounded(features.stack_classes({1: df.filter(odd), 0: df.filter(~odd)}))


@query
def distinct_candidates(spark, d):
    return rounded(mt.distinct_candidates(_tied(spark, d), "score"))


# --- learning ----------------------------------------------------------------------------------------------------

def _held_out(train, spark, d):
    """Fitted on four fifths of the rows: how many of the others are scored, and whether positives rank above negatives."""
    df, names = fx.feature_vectors(spark, d)
    parts = stored(sp_.stratified_split(df, "vec_id", "label"), "split")
    model = train(parts.filter("part = 'train'"), names)
    scored = stored(ml.with_probability(model, parts.filter("part = 'validation'")).select("vec_id", "label", "score"), "scored")
    auc = mt.roc_auc(scored, "score", "label").first()["roc_auc"]
    return scored.select("vec_id", "label", F.col("score").between(0, 1).alias("is_probability"), F.lit(auc > 0.8).alias("ranks_well"))


@query
def train_forest(spark, d):
    return _held_out(ml.train_forest, spark, d)


@query
def train_boosted(spark, d):
    return _held_out(ml.train_boosted, spark, d)


@query
def train_logistic(spark, d):
    return _held_out(ml.train_logistic, spark, d)


@query
def top_features(spark, d):
    df, names = fx.feature_vectors(spark, d)
    # the label depends on the first two features
    return ml.top_features(ml.train_forest(df, names), names, 2).select("feature")


@query
def fill_missing_labels(spark, d):
    filled = tr.fill_missing_labels(fx.labeled(spark, d), "label", "row_id", match_prevalence=True)
    # the threshold is the quantile of the missing rows' scores at the known rows' rate: at most one row off, but for ties
    missing = F.col("label").isNull()
    return filled.rows.agg(
        F.count("*").alias("n_rows"), F.count(F.when(missing, 1)).alias("n_missing"),
        F.count(F.when(~missing & F.col("label_filled").eqNullSafe(F.col("label")), 1)).alias("n_kept"),
        F.count(F.when(missing & F.col("label_filled").eqNullSafe(F.col("pred")), 1)).alias("n_predicted"),
        F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_rate"),
        (F.abs(F.avg(F.col("label").cast("double")) - F.avg(F.when(missing, F.col("label_filled").cast("double")))) < 0.02)
        .alias("rate_matched"))


@query
def fill_report(spark, d):
    df, names = fx.feature_vectors(spark, d)
    return rounded(rd.fill_report(rd.ridge_out_of_fold(df, "vec_id", names[:2], "label", alpha=3.0)), 5)


@query
def fill_evaluated(spark, d):
    # how many rows of each fold were predicted by models of the others, for either model
    parts = []
    for kind in ("logistic", "ridge"):
        report = tr.fill_missing_labels(fx.labeled(spark, d), "label", "row_id", model_type=kind, evaluate=True).report
        ranked = F.col("roc_auc").between(0, 1) & F.col("average_precision").between(0, 1) & (F.col("rmse") < 0.6)
        parts.append(report.select(F.lit(kind).alias("kind"), "fold", "n", ranked.alias("measured")))
    return parts[0].unionByName(parts[1])


@query
def one_hot(spark, d):
    df = fx.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return lb.one_hot(df, "o_orderpriority").drop("o_orderpriority")


@query
def small_data_guard(spark, d):
    df, names = fx.feature_vectors(spark, d)
    kinds = {"all": df, "one_class": df.filter("label = 1")}
    parts = []
    for name, rows in kinds.items():
        held = ml.train_classifier(rows, "vec_id", names, model_type="random_forest").validation
        parts.append(held.groupBy("label").agg(F.count("*").alias("n_held_out")).withColumns({
            "rows": F.lit(name), "guarded": F.lit(ml.small_data_guard(rows))}))
    return parts[0].unionByName(parts[1])


@query
def predict_segments(spark, d):
    df, names = fx.feature_vectors(spark, d)
    bundle = ml.train_classifier(df, "vec_id", names, model_type="logistic")
    held = bundle.validation.select("vec_id", F.lit(True).alias("held"))
    rows = stored(bundle.predict(df).join(held, "vec_id", "left").select(
        "vec_id", "label", "extremist_probability", "is_extremist", F.coalesce("held", F.lit(False)).alias("held_out")), "predicted")
    # rows above the stored cut and below it never mix, and held-out positives rank above negatives
    cut = rows.agg(F.min(F.when(F.col("is_extremist"), F.col("extremist_probability"))).alias("low"),
                   F.max(F.when(~F.col("is_extremist"), F.col("extremist_probability"))).alias("high")).first()
    auc = mt.roc_auc(rows.filter("held_out"), "extremist_probability", "label").first()["roc_auc"]
    return rows.select("vec_id", "held_out", F.lit(cut["low"] > cut["high"]).alias("cut_apart"), F.lit(auc > 0.9).alias("ranks_well"))


@query
def classification_report(spark, d):
    return rounded(mt.classification_report(fx.scored_labels(spark, d), "y", "pred"))


@query
def confusion_matrix(spark, d):
    return mt.confusion_matrix(fx.scored_labels(spark, d), "y", "pred")


@query
def cross_validate(spark, d):
    df, names = fx.feature_vectors(spark, d)
    return ml.cross_validate(df, "vec_id", names, "label", ml.train_logistic).select(
        "vec_id", "label", "fold", F.col("score").between(0, 1).alias("scored"))


@query
def fold_report(spark, d):
    folded = fx.scored_labels(spark, d).select(
        "vec_id", F.col("y").alias("label"), "score", F.pmod("vec_id", F.lit(5)).cast("int").alias("fold"))
    return rounded(mt.fold_report(folded))


@query
def fold_summary(spark, d):
    folded = fx.scored_labels(spark, d).select(
        "vec_id", F.col("y").alias("label"), "score", F.pmod("vec_id", F.lit(5)).cast("int").alias("fold"))
    return rounded(mt.fold_summary(folded))


@query
def regression_metrics(spark, d):
    estimate = 1500.0 * F.col("l_quantity")
    df = fx.table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("y"), estimate.alias("p"), F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold"))
    overall = mt.regression_metrics(df, "y", "p").withColumn("fold", F.lit(-1))
    return rounded(mt.regression_metrics(df, "y", "p", ("fold",)).unionByName(overall), 4)


@query
def model_bundle(spark, d):
    df, names = fx.feature_vectors(spark, d)
    path = scratch_dir(spark, "bundle")
    bundle = ml.train_classifier(df, "vec_id", names, model_type="logistic")
    bundle.save(path)
    first, second = "extremist_probability", "is_extremist"
    twice = ml.Bundle.load(path).predict(bundle.predict(df).withColumnsRenamed({first: "_p", second: "_flag"}))
    return twice.select("vec_id", (F.abs(F.col(first) - F.col("_p")) < 1e-9).alias("same_probability"),
                        (F.col(second) == F.col("_flag")).alias("same_flag"))


# --- scoring and composed jobs ------------------------------------------------------------------------------------

@query
def score_texts(spark, d):
    df = sc.with_classification(scorer.score_texts(fx.table(spark, d, "documents"), fx.word_scorer))
    scored = F.col("error").isNull()
    return rounded(df.select(
        "doc_id", F.when(scored, F.col("overall_toxicity")).alias("overall_toxicity"), F.col("model_outputs.toxic")["toxic"].alias("toxic"),
        F.col("model_outputs.hate")["HATE"].alias("hate"), "error.error_type", "error.error_message"))


@query
def score_with_lexicon(spark, d):
    df = scorer.score_with_lexicon(fx.table(spark, d, "documents"), fx.lexicon(spark))
    toxic = F.col("model_outputs.toxic")
    return rounded(df.select("doc_id", "overall_toxicity", "is_toxic", *[toxic[k].alias(k) for k in TOXIC_LABELS]))


@query
def score_recordings(spark, d):
    return rounded(_rollup(spark, d))


@query
def score_transcripts(spark, d):
    return rounded(rec.score_transcripts(fx.transcripts(spark, d), fx.lexicon(spark)))


@query
def train_from_labels(spark, d):
    rows = fx.labeled(spark, d).filter("label is not null").select("row_id", "text", "label")
    measured = stored(tr.measured_texts(rows, fx.lexicon(spark)), "measured", "zstd")  # both modes read them
    held = []
    for name, make in (("text_only", None), ("model", fx.word_scorer)):
        bundle = tr.train_from_labels(measured, "row_id", None, "logistic", make_scorer=make)
        # which rows were held out, and that the model ranks them well
        auc = mt.roc_auc(bundle.validation, "score", "label").first()["roc_auc"]
        held.append(bundle.validation.select("row_id", "label", F.lit(name).alias("mode"), F.lit(auc > 0.75).alias("ranks_well")))
    return held[0].unionByName(held[1])


def _write_documents(spark, d, path, condition=None):
    """The documents as transcripts, one per line; every 13th is cut off within its JSON."""
    lines = fx.transcripts(spark, d).filter(F.lit(True) if condition is None else condition).withColumn(
        "value", F.to_json(F.struct("file", "text", "language", "segments")))
    cut = F.expr("substring(value, 1, length(value) - 1)")
    lines.select(F.when(fx.doc_id() % 13 == 0, cut).otherwise(F.col("value")).alias("value")).write.text(path)


@query
def process_directory(spark, d):
    path = scratch_dir(spark, "directory")
    first = F.pmod(fx.doc_id(), F.lit(5)) == 0
    _write_documents(spark, d, f"{path}/in/a", first)
    dr.process_directory(spark, f"{path}/in", f"{path}/out", fx.lexicon(spark), one_per_file=False, pattern="*.txt")
    _write_documents(spark, d, f"{path}/in/b", ~first)
    return dr.process_directory(
        spark, f"{path}/in", f"{path}/out", fx.lexicon(spark), one_per_file=False, pattern="*.txt").select(
        "total", "processed", "skipped", "failed")


@query
def reload_written_results(spark, d):
    path = scratch_dir(spark, "directory")
    _write_documents(spark, d, f"{path}/in")
    dr.process_directory(spark, f"{path}/in", f"{path}/out", fx.lexicon(spark), one_per_file=False, pattern="*.txt")
    return rounded(dr.directory_results(spark, f"{path}/out").select(
        "file", "valid", "result", F.col("isExtremist").alias("is_extremist"),
        F.size("segments").cast("bigint").alias("n_segments"), F.col("statistics.max_toxicity").alias("max_toxicity"),
        F.col("full_text_classification.overall_toxicity").alias("full_text_toxicity"),
        F.col("full_text_classification.is_toxic").alias("full_text_toxic")))


@query
def train_from_pairs(spark, d):
    found = pr.paired_segments(spark, fx.write_pairs(spark, d, scratch_dir(spark, "pairs")))
    rows = stored(found.rows, "paired")
    held = pr.train_from_pairs(rows, "logistic").validation.select(
        F.col("row").alias("held_row"), (F.col("prediction") + F.col("score") >= 0).alias("scored"))
    wanted = ("overall_toxicity", "is_toxic", "toxic_toxic", "hate_HATE", "sentiment_positive", "custom_score", "f0_mean",
              "duration", "emotion_is_happy")
    return rounded(rows.join(held, F.concat_ws("#", "file", "seg_idx") == F.col("held_row"), "left").select(
        "file", F.col("seg_idx").cast("int").alias("seg_idx"), "label", F.size("features").alias("n_features"),
        F.coalesce("scored", F.lit(False)).alias("held_out"), *[F.col("features")[n].alias(n) for n in wanted]))


@query
def predict_pairs(spark, d):
    found = pr.paired_segments(spark, fx.write_pairs(spark, d, scratch_dir(spark, "pairs")))
    rows = stored(found.rows, "paired")
    bundle = pr.train_from_pairs(rows, "logistic")
    # the model's scores differ between releases: what is determined, and that toxic recordings rank above the others
    stats = stored(pr.predict_pairs(rows, bundle).statistics, "predicted")
    ranked = mt.roc_auc(stats.withColumn("label", F.substring("file", 1, 1).cast("int")), "avg_extremist_probability", "label")
    both = F.col("extremist_segments") + F.col("non_extremist_segments") == F.col("total_segments")
    return stats.select("file", "total_segments", both.alias("adds_up"), F.col("is_extremist_content").isNotNull().alias("decided")).join(
        ranked.select((F.col("roc_auc") > 0.8).alias("ranks_well")))


@query
def broken_pair_members(spark, d):
    found = pr.paired_segments(spark, fx.write_pairs(spark, d, scratch_dir(spark, "pairs")))
    return found.broken.select("file", "file_type", "error_type", "error_message")


@query
def acoustic_rows(spark, d):
    signals = fx.signals(spark, d)
    return rounded(acoustics.acoustic_rows(
        signals["segments"], signals["chunks"], signals["contours"], signals["emotions"], min_energy_samples=120,
        min_pitch_samples=200, settings=replace(DEFAULTS, sample_rate=fx.SIGNAL_RATE), block=256), 5)


@query
def split_tsv_dir(spark, d):
    path = scratch_dir(spark, "tsv")
    fx.write_tsv_files(spark, d, path)
    parts = scratch_dir(spark, "parts")
    done = tsv.split_tsv_dir(spark, path, parts, 7)
    lines = tsv.numbered_lines(tsv.text_lines(spark, parts, tsv.TSV), F.substring_index("address", "/", -1))
    file = F.regexp_replace("name", r"\.part[0-9]+\.tsv$", ".tsv")
    rows = lines.filter("line > 0").withColumn("place", F.when(F.col("name").contains("_1."), 1).otherwise(0))
    found = rows.select(
        file.alias("name"), F.regexp_extract("name", r"part([0-9]+)", 1).cast("int").alias("part"),
        F.split("value", "\t")[F.col("place")].cast("bigint").alias("row_id"))
    counted = found.groupBy("name", "part").agg(
        F.count("*").alias("rows_of_part"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))
    return done.join(counted, "name", "left")
