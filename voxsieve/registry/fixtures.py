"""Operator inputs derived from the given tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.features import ACOUSTIC
from ..functions.scores import sigmoid, sigmoid_scores, softmax_map, with_classification
from ..functions.text import strip, with_text_proxies
from ..operators.lexicon import pieces
from ..operators.segments import explode_segments
from ..plans.recordings import timed_segments
from ..settings import TOXIC_LABELS
from ..sources.pairs import ACOUSTIC_SUFFIX, OUTPUTS, TEXT_SUFFIX
from ..sources.recording_files import PACKED, write_line_files, write_recording_files

# A small valence lexicon and the label vocabularies of the score fixture.
LEXICON = {
    **dict.fromkeys(("trash", "pathetic", "idiot", "worthless", "disgusting",
                     "stupid", "clown", "loser", "scum", "moron"), -9.0),
    "with": 2.0, "for": 1.5, "this": 1.0,
}
TARGETS = ("not_cyberbullying", "religion", "race", "gender", "disability", "age", "ethnicity_based")
EMOTION_CYCLE = ("angry", "fear", "happy", "neutral", "sad", "disgust")
MIXED_LABELS = ("1", " Yes ", "TRUE", "y", "extremist", "0", "no", "n", "non-extremist", "non extremist",
                "not extremist", "2", "1.9", "-1.5", "abc", "", None)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{term}', {valence}D)" for term, valence in LEXICON.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS lexicon(term, valence)")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    blank = F.lit(None).cast("double")
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file"), "text", F.col("lang").alias("language"),
        F.transform(F.split("text", "\n"), lambda line: F.struct(
            blank.alias("start"), blank.alias("end"), line.alias("text"))).alias("segments"))


def segs(spark: SparkSession, d: str) -> DataFrame:
    return timed_segments(transcripts(spark, d), lexicon(spark))


def word_valences(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the documents as a term: a lexicon that grows with them, with repeated and null terms."""
    words = table(spark, d, "documents").select(F.explode(pieces(F.col("text"))).alias("term")).filter("term <> ''").distinct()
    valence = (F.length("term") % 9 - 4).cast("double")
    kinds = ((F.col("term"), valence), (F.col("term"), valence / 2), (F.lit(None).cast("string"), valence))
    return words.select(F.inline(F.array(*[F.struct(term.alias("term"), v.alias("valence")) for term, v in kinds])))


def word_scorer():
    """A model that counts words (fixed values); it fails on texts of more than 20,000 characters."""
    words = ("idiot", "scum", "trash", "moron")

    def score(texts: list[str]) -> list[dict[str, dict[str, float]]]:
        if any(len(t) > 20_000 for t in texts):
            raise ValueError("too long")
        hits = [sum(t.count(w) for w in words) for t in texts]
        return [{"toxic": {"toxic": min(1.0, n / 4)}, "hate": {"HATE": n / (n + 1), "NOT-HATE": 1 / (n + 1)}} for n in hits]

    return score


def doc_id() -> Column:
    return F.substring_index("file", "_", -1).cast("bigint")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id and the embedding as DOUBLE array x."""
    return table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def x(i: int) -> Column:
    return F.col("x")[i - 1]


def s(i: int) -> Column:
    return sigmoid(12 * x(i))


def logits(*terms: Column) -> Column:
    return F.array(*terms)


def model_outputs(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, x and the five model score maps."""
    outputs = F.struct(
        sigmoid_scores(logits(*[12 * x(i) - 2 for i in range(1, 7)]), list(TOXIC_LABELS)).alias("toxic"),
        softmax_map(logits(12 * x(7) - 2, 12 * x(8)), ["HATE", "NOT-HATE"]).alias("hate"),
        softmax_map(logits(12 * x(9) - 2, 12 * x(10)), ["offensive", "non-offensive"]).alias("offensive"),
        softmax_map(logits(*[12 * x(i) for i in (11, 12, 13)]), ["negative", "neutral", "positive"]).alias("sentiment"),
        sigmoid_scores(logits(*[12 * x(i) - 1 for i in range(14, 21)]), list(TARGETS)).alias("target"))
    return vectors(spark, d).withColumn("model_outputs", outputs)


def scores(spark: SparkSession, d: str) -> DataFrame:
    return with_classification(model_outputs(spark, d))


def segs_with_scores(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Segments joined to score rows by a number spread over all score rows."""
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n")).scalar()
    rows = explode_segments(transcripts(spark, d), keep_blank=True)
    keyed = rows.withColumn("vec_id", F.pmod(doc_id() * 8 + F.col("seg_idx"), n))
    return keyed.join(scores(spark, d).select("vec_id", *columns), "vec_id")


def acoustic(spark: SparkSession, d: str) -> DataFrame:
    """Score rows with acoustic columns spread over their ranges."""
    df = scores(spark, d).withColumns({
        "f0_std": 5 + 75 * s(21), "f0_range": 30 + 270 * s(22), "f0_slope": 200 * x(23),
        "duration": 0.3 + 9.7 * s(24),
        "emotion": F.array(*map(F.lit, EMOTION_CYCLE))[F.pmod("vec_id", F.lit(6)).cast("int")],
        "emotion_score": s(25), "rms_mean": 0.12 * s(26), "f0_mean": 170 + 40 * x(27),
    })
    return df.withColumns({
        "rms_max": F.least(1.8 * F.col("rms_mean"), F.lit(0.2)),
        "f0_min": F.col("f0_mean") - F.col("f0_range") / 2,
        "f0_max": F.col("f0_mean") + F.col("f0_range") / 2,
        "f0_final": F.col("f0_mean"),
    })


def labeled(spark: SparkSession, d: str) -> DataFrame:
    """row_id, text, label (null where unlabelled), numeric and categorical features."""
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return with_text_proxies(docs.join(labels, "doc_id", "left")).withColumnRenamed("doc_id", "row_id")


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Several ratings per comment with gaps in value and label."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("comment_id"), F.col("event_id").alias("note_id"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("rating"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 0).alias("label"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"))


def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, score, y, pred."""
    return vectors(spark, d).select(
        "vec_id", "x", sigmoid(12 * x(1) - 2).alias("score"),
        (x(1) + 1.5 * x(2) > 0.1).cast("int").alias("y"),
    ).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def feature_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """vec_id, label and the embedding as 64 named columns."""
    names = [f"d{i:02d}" for i in range(64)]
    df = scored_labels(spark, d).select(
        "vec_id", F.col("y").alias("label"), *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    return df, names


def urls(spark: SparkSession, d: str) -> DataFrame:
    """page_id and page addresses, varied into media, foreign and malformed ones."""
    kind = F.pmod("page_id", F.lit(9))
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", (
        F.when(kind == 0, F.concat(bare, F.lit(".MP4?x=1")))
        .when(kind == 1, F.concat(bare, F.lit(".wav")))
        .when(kind == 2, F.regexp_replace("url", "^https?:", "ftp:"))
        .when(kind == 3, F.regexp_replace("url", "^https?://", ""))
        .when(kind == 4, F.lit(""))
        .when(kind == 5, F.lit(None).cast("string"))
        .when(kind == 6, F.concat(bare, F.lit("/clip.final.mp3")))
        .when(kind == 7, F.lit("https://"))
        .otherwise(F.col("url"))).alias("url"))


def event_points(spark: SparkSession, d: str, kind: str, hourly: bool) -> DataFrame:
    """Events of a kind as points in seconds per user."""
    ts = F.date_trunc("hour", "ts") if hourly else F.col("ts")
    return (
        table(spark, d, "events").filter(F.col("event_type") == kind)
        .select(F.col("user_id").alias("file"), "event_id",
                (F.unix_micros(ts.cast("timestamp")) / 1e6).alias("mid")))


#: How far the acoustic segments of the pair files lie behind the classified ones, in seconds.
PAIR_SHIFT = 0.37


def write_pairs(spark: SparkSession, d: str, path: str) -> dict[int, str]:
    """Every document as a pair of packed feature files, in one folder per class; returns the folders.

    Every third segment has no acoustic row and every 23rd document no acoustic file; the classified file of every
    17th document is cut off, and the acoustic file of every 19th holds no list.
    """
    key, file = F.struct("file").alias("key"), F.concat(F.lit("doc_"), "doc_id").alias("file")  # a null file is one too
    toxic = table(spark, d, "labels").filter("toxic = 1 AND doc_id IS NOT NULL").select(file).groupBy(key).agg(F.count("*").alias("times"))
    # texts are dealt out once, by document: segments carry the name of theirs instead
    named = transcripts(spark, d).withColumn("document", F.md5("text"))
    spoken = F.transform("segments", lambda s: strip(F.coalesce(s["text"], F.lit(""))))
    texts = named.groupBy(key).agg(F.collect_set(F.struct("document", spoken.alias("texts"))).alias("documents"))
    # one group holds both files of a document: segments are scored and dealt out once
    near = (F.col("seg_idx") % 3 < 2) & (doc_id() % 23 != 0)
    rows = timed_segments(named, lexicon(spark)).groupBy(key).agg(F.collect_list(F.struct(
        "seg_idx", "document", "start_s", "end_s", "overall_toxicity", "is_toxic", "model_outputs",
        F.when(near, F.struct("emotion", *ACOUSTIC)).alias("heard"))).alias("rows"))
    # a document that is labelled several times has its segments as often
    often = F.flatten(F.transform("rows", lambda r: F.array_repeat(r, F.col("times").cast("int"))))
    found = rows.join(texts, "key").join(toxic, "key", "left").select(
        "key.file", "documents", F.concat_ws("/", F.when(F.col("times").isNotNull(), "1").otherwise("0"), "key.file").alias("base"),
        F.when(F.col("times") > 1, often).otherwise(F.col("rows")).alias("rows"))

    def text(r: Column) -> Column:
        own = F.filter("documents", lambda t: t["document"] == r["document"])
        outputs = F.struct(*[r["model_outputs"][m].alias(name) for m, name in OUTPUTS.items()])
        return F.struct(
            r["start_s"].alias("start"), r["end_s"].alias("end"), own[0]["texts"][r["seg_idx"]].alias("text"),
            r["overall_toxicity"].alias("overall_toxicity"), r["is_toxic"].alias("is_toxic"),
            F.array().cast("array<string>").alias("detected_issues"), outputs.alias("model_outputs"),
            F.create_map(F.lit("custom_score"), F.lit(0.25), F.lit("f0_mean"), F.lit(1.0)).alias("categories"))

    def heard(r: Column) -> Column:
        late = [(r[f"{x}_s"] + PAIR_SHIFT).alias(x) for x in ("start", "end")]
        return F.struct(*late, *[r["heard"][c].alias(c) for c in ("emotion", *ACOUSTIC)])

    def listed(rows: Column, row: Callable[[Column], Column]) -> Column:
        placed = F.array_sort(F.transform(rows, lambda r: F.struct(r["seg_idx"].alias("seg_idx"), F.to_json(row(r)).alias("json"))))
        return F.concat(F.lit("["), F.array_join(placed["json"], ", "), F.lit("]"))

    others = F.filter("rows", lambda r: r["heard"].isNotNull())
    lists = found.select("file", "base", listed(F.col("rows"), text).alias("text"), F.when(F.size(others) > 0, listed(others, heard)).alias("heard"))
    whole = F.concat(F.lit('{"segment_classifications": '), "text", F.lit("}"))
    cut = F.when(doc_id() % 17 == 0, F.expr("substring(text, 1, length(text) - 2)")).otherwise(whole)
    odd = F.when(doc_id() % 19 == 0, F.concat(F.lit('{"rows": '), "heard", F.lit("}"))).otherwise(F.col("heard"))
    files = lists.select(F.inline_outer(F.array(*[
        F.struct(F.concat("base", F.lit(suffix + PACKED)).alias("name"), value.alias("value"))
        for suffix, value in ((TEXT_SUFFIX, cut), (ACOUSTIC_SUFFIX, odd))])))
    write_recording_files(files.filter("value is not null"), path)
    return {c: f"{path}/{c}" for c in (0, 1)}


#: Samples per second of the signals that vectors stand for, and vectors per recording.
SIGNAL_RATE = 1_000
CHUNKS = 50


def signals(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Vectors as chunks of signals, one segment, one pitch contour and one set of emotion scores each."""
    rows = model_outputs(spark, d).withColumns({
        "file": F.concat(F.lit("rec_"), F.floor(F.col("vec_id") / CHUNKS).cast("string")),
        "seg_idx": F.pmod("vec_id", F.lit(CHUNKS)).cast("int")})
    start = F.col("seg_idx") * 0.064 + 0.2 * x(1)
    return {
        "chunks": rows.select("file", (F.col("seg_idx") * 64).alias("offset"), F.col("x").alias("samples")),
        "segments": rows.select(
            "file", "seg_idx", start.alias("start_s"), (start + 0.15 + 2 * x(2)).alias("end_s"), F.lit("x").alias("text")),
        "contours": rows.select("file", "seg_idx", F.posexplode("x").alias("frame", "v")).select(
            "file", "seg_idx", "frame", F.when(F.col("v") > 0, 100 + 200 * F.col("v")).alias("f0")),
        "emotions": rows.filter("vec_id % 7 <> 0").select("file", "seg_idx", F.col("model_outputs.sentiment").alias("scores")),
    }


#: Column orders of the TSV files, and those of their columns that a file may lack.
LAYOUTS = (("row_id", "text", "label"), ("label", "row_id", "text"), ("row_id", "lang", "text"))


def write_tsv_files(spark: SparkSession, d: str, path: str) -> None:
    """Documents as one .tsv file per source and layout, rows by id; the file of src4 and the first layout has an open quote."""
    rows = labeled(spark, d).withColumns({
        "text": F.regexp_replace("text", r'["\s]+', " "), "layout": F.pmod("row_id", F.lit(len(LAYOUTS))).cast("int")})
    lines = [F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]) for names in LAYOUTS]
    line = F.array(*lines)[F.col("layout")]
    named = rows.select(F.concat_ws("_", "source", "layout").alias("file"), "layout", "row_id", F.concat(
        line, F.when((F.col("source") == "src4") & (F.col("layout") == 0), F.lit('\t"open')).otherwise(F.lit(""))).alias("value"))
    heads = named.select("file", "layout").distinct().select("file", F.lit(-1).cast("bigint").alias("row_id"), F.array(
        *[F.lit("\t".join(names)) for names in LAYOUTS])[F.col("layout")].alias("value"))
    write_line_files(named.drop("layout").unionByName(heads).withColumn("name", F.concat("file", F.lit(".tsv"))), "row_id", path)
