import json

from voxsieve.registry import fixtures as fx
from voxsieve.streaming.jobs import score_new_transcripts, score_open_transcripts


def add(folder, name, line):
    (folder / f"{name}.json").write_text(json.dumps({"text": line, "language": "en", "segments": [{"start": 0, "end": 1, "text": line}]}))


def test_only_new_transcripts_are_scored(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lexicon = fx.lexicon(spark)

    def run():
        q = score_new_transcripts(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ckpt"), lexicon)
        assert q.awaitTermination(90)
        return {(r.batch, r.file) for r in spark.read.parquet(str(tmp_path / "out")).select("batch", "file").collect()}

    add(source, "a", "good day to you")
    assert run() == {(0, "a.json")}
    add(source, "b", "idiot scum trash!")
    assert run() == {(0, "a.json"), (1, "b.json")}
    assert run() == {(0, "a.json"), (1, "b.json")}


def test_transcripts_with_results_are_not_opened(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lexicon, done = fx.lexicon(spark), spark.sql("SELECT 'old.json' AS file")
    add(source, "old", "never read")
    add(source, "a b", "good day to you")
    (source / "cut.json").write_text("{")

    def run():
        q = score_open_transcripts(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ckpt"), lexicon, done)
        assert q.awaitTermination(90)
        errors = spark.read.json(str(tmp_path / "out_errors"))
        return {r.file for r in spark.read.parquet(str(tmp_path / "out")).collect()}, {r.file for r in errors.collect()}

    assert run() == ({"a b.json"}, {"cut.json"})
    add(source, "c", "idiot scum trash!")
    assert run() == ({"a b.json", "c.json"}, {"cut.json"})
