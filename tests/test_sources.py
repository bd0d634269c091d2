import json

import pytest
from pyspark.sql import functions as F

from voxsieve.operators.rollup import run_summary
from voxsieve.plans import recordings as rec
from voxsieve.registry import fixtures as fx
from voxsieve.operators import rollup as ru
from voxsieve.sources import media, results, tables as tb, transcripts as ts, tsv


def test_one_transcript_per_file(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"text": " hi ", "segments": [{"start": 0, "end": 1.5, "text": "hi"}]}, indent=2))
    (tmp_path / "bad" / "b.json").write_text("{}")
    (tmp_path / "notes.txt").write_text("x")
    got = {r.file: r for r in ts.read_transcripts(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.json", "bad/b.json"}
    assert (got["a.json"].text, got["a.json"].language, got["a.json"].segments[0].end) == ("hi", "unknown", 1.5)
    assert got["bad/b.json"].segments == []
    classes = {r.file: r.class_name for r in ts.read_transcripts(spark, str(tmp_path), with_class=True).collect()}
    assert classes == {"a.json": tmp_path.name, "bad/b.json": "bad"}


def test_labeled_csv_keeps_file_order_and_finds_columns(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('id,Text,Label\n1,"two\nlines",yes\n2,,1\n3,"say ""no""",0\n4,x,what\n5,y,1\n')
    got = [(r.text, r.label) for r in tb.read_labeled_csv(spark, str(path), n_rows=4).collect()]
    assert got == [("two\nlines", 1), ('say "no"', 0)]
    assert tb.read_labeled_csv(spark, str(path), text_column="Text").count() == 3
    (tmp_path / "e.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="available columns"):
        tb.read_labeled_csv(spark, str(tmp_path / "e.csv"))


def test_parts_have_no_empty_tail(spark, tmp_path):
    parts = tb.split_parts(spark.range(20), "id", 10)
    assert sorted((r.part, r["count"]) for r in parts.groupBy("part").count().collect()) == [(1, 10), (2, 10)]
    tb.write_parts(parts, str(tmp_path / "parts"))
    assert sorted(p.name for p in (tmp_path / "parts").glob("part=*")) == ["part=1", "part=2"]


def test_part_names_are_not_split_again(spark):
    names = ["a.tsv", "a.part1.tsv", "A.TSV", "a.csv", "a.partx.tsv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.filter(tsv.is_splittable_name(F.col("n"))).collect()] == ["a.tsv", "A.TSV", "a.partx.tsv"]


def test_manifest_lists_media_only(spark, tmp_path):
    for n in ("b.MP4", "a.wav", "c.txt", "mp3"):
        (tmp_path / n).write_text("x")
    got = [(r.path.rsplit("/", 1)[1], r.file_type) for r in media.media_manifest(media.list_files(spark, str(tmp_path))).collect()]
    assert got == [("a.wav", "audio"), ("b.MP4", "video")]


def test_invalid_results_are_reported(spark, tmp_path):
    (tmp_path / "x-result.json").write_text(json.dumps({"success": True, "segments": []}))
    (tmp_path / "y.json").write_text(json.dumps({"segments": []}))
    (tmp_path / "z.json").write_text("{broken")
    got = {r.file: (r.valid, r.error) for r in ts.reload_results(spark, str(tmp_path)).collect()}
    assert got["x"] == (True, None)
    assert got["y.json"][0] is False and got["y.json"][1].startswith("Invalid JSON format")
    assert got["z.json"] == (False, "Failed to parse JSON file")


def test_results_per_recording(spark, small, tmp_path):
    some = fx.transcripts(spark, small).filter(fx.doc_id() < 4)
    scored = rec.score_recordings(some, fx.lexicon(spark))
    docs = ru.json_envelope(scored.segments, scored.statistics, ["text", "extreme"])
    results.write_results(docs, scored.statistics, str(tmp_path / "r"), per_recording=True)
    folder = tmp_path / "r" / "documents"
    assert sorted(p.name for p in folder.iterdir()) == [f"doc_{i}-result.json" for i in range(4)]
    again = ts.reload_results(spark, str(folder))
    assert {r.file: len(r.segments) for r in again.collect()} == {
        r.file: r.n_segments for r in docs.select("file", "n_segments").collect()}


def test_run_summary_spans_time(spark):
    df = spark.sql("""SELECT * FROM VALUES ('processed', timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:05'),
        ('failed', timestamp'2024-01-01 00:00:05', timestamp'2024-01-01 00:01:00') AS t(status, started_at, ended_at)""")
    r = run_summary(df).first()
    assert (r.total, r.processed, r.skipped, r.failed, r.duration_seconds) == (2, 1, 0, 1, 60.0)


def test_stems_keep_inner_dots(spark):
    a = spark.createDataFrame([("x.y.mp4",), ("z.mp4",), (".mp4",)], "file string")
    done = spark.createDataFrame([("x.y.json",)], "file string")
    assert sorted(r.file for r in media.skip_existing(a, done).collect()) == [".mp4", "z.mp4"]


def test_broken_transcripts_are_error_rows(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"text": "x"}')
    (tmp_path / "cut.json").write_text('{"text": "idiot", "segm')
    (tmp_path / "blank.json").write_text(" \n")
    files = ts.transcript_files(spark, str(tmp_path))
    assert {r.file: r.error_type for r in ts.broken_transcripts(files).collect()} == {
        "cut.json": "JSONDecodeError", "blank.json": "JSONDecodeError"}
    assert [r.file for r in ts.read_transcripts(spark, str(tmp_path)).collect()] == ["good.json"]
    assert ts.read_transcripts(spark, str(tmp_path)).count() == 1


def test_written_results_can_be_read_again(spark, small, tmp_path):
    some = fx.transcripts(spark, small).filter(fx.doc_id() < 4)
    scored = rec.score_recordings(some, fx.lexicon(spark), store=True)
    docs = ru.json_envelope(scored.segments, scored.statistics, ru.display_fields(), documents=rec.document_scores(some, fx.lexicon(spark)))
    results.write_results(docs, scored.statistics, str(tmp_path / "r"))
    got = ts.reload_results(spark, str(tmp_path / "r" / "documents"), one_per_file=False, pattern="*.txt")
    rows = {r.file: r for r in got.collect()}
    assert sorted(rows) == [f"doc_{i}" for i in range(4)] and all(r.valid for r in rows.values())
    for s in scored.statistics.collect():
        r = rows[s.file]
        assert (r.result, r.isExtremist, len(r.segments)) == (s.result, s.is_extremist_content, s.total_segments)
        assert r.statistics.max_toxicity == pytest.approx(s.max_toxicity)
        assert r.full_text_classification.overall_toxicity is not None
