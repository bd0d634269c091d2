"""Recordings stored as pairs of feature files, and the sink that writes files by name."""

import gzip
import json

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from voxsieve.operators import align
from voxsieve.plans import pairs as pr
from voxsieve.registry import fixtures as fx
from voxsieve.sources.pairs import acoustic_segments, classified_segments, feature_files
from voxsieve.sources.recording_files import write_recording_files


def put(folder, base, text, heard):
    folder.mkdir(parents=True, exist_ok=True)
    for suffix, value in (("_multimodel.json", text), ("_intonation.json", heard)):
        if value is not None:
            (folder / f"{base}{suffix}").write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def segment(start, end, **more):
    return {"start": start, "end": end, "text": "x", **more}


def test_pairs_of_files(spark, tmp_path):
    yes, no = tmp_path / "yes", tmp_path / "no"
    scores = {
        "overall_toxicity": 0.7, "is_toxic": True, "hate_target": " Some Group ", "hate_target_confidence": 0.5,
        "detected_issues": ["toxic_toxic:0.900"], "categories": {"toxic_toxic": 0.1, "own": 0.3, "emotion_score": 9, "bad": "x"},
        "model_outputs": {"toxic_bert": {"toxic": 0.9}, "target_analysis": {"a": 0.2, "b": 0.6}}}
    put(yes / "deep", "a b+c%", {"segment_classifications": [segment(0, 2, **scores), segment(50, 52)]},
        [segment(9, 11, f0_mean=1.0), segment(0.2, 2.2, f0_mean=120.5, emotion="Very Angry", emotion_score=0.8, rms_max=None)])
    put(no, "a b", {"segment_classifications": [segment(0, 2, overall_toxicity=None, hate_target=""), {"text": "no times"}]},
        [segment(0.1, 2.1)])
    put(no, "alone", {"segment_classifications": [segment(0, 1)]}, None)
    put(no, "cut", '{"segment_classifications": [', [segment(0, 1)])
    put(no, "cut2", {"segment_classifications": [segment(0, 1)]}, "[{")
    put(no, "object", {"segment_classifications": [segment(0, 1)]}, {"rows": [segment(0, 1)]})
    put(no, "empty", {"other": 1}, [])
    found = pr.paired_segments(spark, {1: str(yes), 0: str(no)})
    rows = {(r.file, r.seg_idx): r for r in found.rows.collect()}
    assert set(rows) == {("1/deep/a b+c%", 0), ("0/a b", 0)}
    one, other = rows["1/deep/a b+c%", 0], rows["0/a b", 0]
    assert (one.label, other.label) == (1, 0)
    wanted = {
        "overall_toxicity": 0.7, "is_toxic": 1.0, "hate_target_confidence": 0.5, "hate_target_is_some_group": 1.0, "toxic_toxic": 0.9,
        "target_a": 0.2, "target_b": 0.6, "target_max_score": 0.6, "num_detected_issues": 1.0, "own": 0.3, "f0_mean": 120.5,
        "emotion_score": 0.8, "emotion_is_angry": 1.0, "emotion_is_sad": 0.0, "rms_max": 0.0}
    assert {k: one.features[k] for k in wanted} == wanted and "bad" not in one.features
    assert other.features["overall_toxicity"] == 0.0 and other.features["emotion_is_neutral"] == 1.0
    assert sorted((r.file, r.file_type) for r in found.broken.collect()) == [("0/cut", "multimodel"), ("0/cut2", "intonation")]


def test_train_and_predict(spark, tmp_path):
    for label, folder in ((1, "yes"), (0, "no")):
        for i in range(12):
            parts = [segment(k, k + 1.0, overall_toxicity=0.9 * label + 0.01 * k) for k in range(6)]
            extra = {"model_outputs": {"toxic_bert": {"toxic": float(label)}}} if i % 2 else {}
            put(tmp_path / folder, f"r{i}", {"segment_classifications": [p | extra for p in parts]},
                [segment(k + 0.1, k + 1.1, f0_std=float(k)) for k in range(6)])
    found = pr.paired_segments(spark, {1: str(tmp_path / "yes"), 0: str(tmp_path / "no")})
    bundle = pr.train_from_pairs(found.rows, "logistic")
    assert "toxic_toxic" in bundle.names and "f0_std" in bundle.names
    stats = {r.file: r for r in pr.predict_pairs(found.rows, bundle).statistics.collect()}
    assert len(stats) == 24 and {r.total_segments for r in stats.values()} == {6}
    assert all(r.is_extremist_content == f.startswith("1/") for f, r in stats.items())


def test_files_are_named_by_their_rows(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.range(40, numPartitions=4).select(
        F.concat(F.lit("d"), F.col("id") % 3, F.lit("/n "), "id", F.lit(".json")).alias("name"),
        F.when(F.col("id") > 0, F.concat(F.lit("é"), "id")).alias("value"))
    for _ in range(2):  # again: replaced, not added
        write_recording_files(rows, str(folder))
        names = sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())
        assert names == sorted(f"d{i % 3}/n {i}.json" for i in range(40))
    assert (folder / "d1/n 7.json").read_text() == "é7" and (folder / "d0/n 0.json").read_text() == ""
    write_recording_files(rows.filter("false"), str(tmp_path / "none"))


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    def fail_late(batches):
        for batch in batches:
            yield batch
        if TaskContext.get().partitionId() == 1:
            raise RuntimeError("lost")

    rows = spark.range(40, numPartitions=2).select(
        F.concat(F.lit("n"), "id").alias("name"), F.lit("x").alias("value")).mapInArrow(fail_late, "name string, value string")
    with pytest.raises(Exception, match="lost"):
        write_recording_files(rows, str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert all(int(p.name[1:]) < 20 for p in files)
    with pytest.raises(Exception, match="no name"):
        write_recording_files(spark.sql("SELECT '../x' AS name, 'y' AS value"), str(tmp_path / "bad"))
    assert not (tmp_path / "x").exists()


def test_files_may_be_packed(spark, tmp_path):
    text, heard = {"segment_classifications": [segment(0, 2, overall_toxicity=0.5)]}, [segment(0.1, 2.1, f0_mean=9.0)]
    values = {"1/a_multimodel.json.gz": json.dumps(text), "1/a_intonation.json.gz": json.dumps(heard), "1/b_multimodel.json": json.dumps(text),
              "1/b_intonation.json.gz": json.dumps(heard), "1/cut_multimodel.json.gz": '{"segment_classifications": ['}
    write_recording_files(spark.createDataFrame([*values.items()], "name string, value string").coalesce(1), str(tmp_path))
    packed = tmp_path / "1" / "a_multimodel.json.gz"
    assert json.loads(gzip.decompress(packed.read_bytes())) == text
    (tmp_path / "1" / "short_intonation.json.gz").write_bytes(packed.read_bytes()[:-9])
    (tmp_path / "1" / "bad_intonation.json.gz").write_bytes(b"no gzip")
    found = pr.paired_segments(spark, {1: str(tmp_path / "1")})
    assert sorted((r.file, r.seg_idx, r.features["f0_mean"]) for r in found.rows.collect()) == [("1/a", 0, 9.0), ("1/b", 0, 9.0)]
    assert sorted((r.file, r.file_type) for r in found.broken.collect()) == [
        ("1/bad", "intonation"), ("1/cut", "multimodel"), ("1/short", "intonation")]
    readable = [p.base for p in feature_files(spark, f"{tmp_path}/[1]")[0].select("base").collect()]  # by Spark's reader
    assert sorted(b.rpartition("/")[2] for b in readable) == ["a", "b", "cut"]


def test_pairs_are_aligned_without_their_texts_and_parsed_once(spark, tmp_path, monkeypatch):
    put(tmp_path, "a", {"segment_classifications": [segment(0, 2)]}, [segment(0.1, 2.1)])
    kept, plain = {}, align.stored
    monkeypatch.setattr(align, "stored", lambda df, name, *more: kept.setdefault(name, plain(df, name, *more)))
    assert pr.paired_segments(spark, {1: str(tmp_path)}).rows.count() == 1
    assert "overall_toxicity" in kept["left"].columns and "text" not in kept["left"].columns
    for rows, files in zip((classified_segments, acoustic_segments), feature_files(spark, str(tmp_path)), strict=True):
        assert rows(files)._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1


def test_pair_files_of_documents(spark, tmp_path):
    """Segments keep their own text, also where ids repeat or are null; repeated labels repeat segments."""
    rows = [(1, "one idiot\n\nthree"), (2, "first"), (2, "other\nmore"), (3, None), (4, "twice\nlabelled"), (17, "cut off"), (None, "no id"), (23, "silent")]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (4, 1), (4, 1), (2, 1), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folders = fx.write_pairs(spark, str(tmp_path), str(tmp_path / "pairs"))
    assert folders == {0: f"{tmp_path}/pairs/0", 1: f"{tmp_path}/pairs/1"}
    read = {str(p.relative_to(tmp_path / "pairs")): gzip.decompress(p.read_bytes()).decode() for p in (tmp_path / "pairs").rglob("*.gz")}
    names = {"0/doc_1": 1, "1/doc_2": 1, "1/doc_4": 1, "0/doc_17": 1, "0": 0, "0/doc_23": 0}
    assert set(read) == {f"{n}_multimodel.json.gz" for n in names} | {f"{n}_intonation.json.gz" for n, both in names.items() if both}
    cut = read.pop("0/doc_17_multimodel.json.gz")
    assert cut.startswith("[{") and not cut.endswith("}]")
    texts = {n.partition("_multi")[0]: [s["text"] for s in json.loads(v)["segment_classifications"]] for n, v in read.items() if "_multi" in n}
    assert {n: sorted(t) for n, t in texts.items()} == {
        "0/doc_1": ["", "one idiot", "three"], "1/doc_2": ["first", "more", "other"], "0": ["no id"], "0/doc_23": ["silent"],
        "1/doc_4": ["labelled", "labelled", "twice", "twice"]}
    assert [s["start"] for s in json.loads(read["1/doc_4_multimodel.json.gz"])["segment_classifications"]][:2] == [0.0, 0.0]
    assert all(s["f0_mean"] > 0 for s in json.loads(read["1/doc_2_intonation.json.gz"]))
