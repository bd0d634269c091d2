"""A directory in, stored results out."""

import json
from pathlib import Path
from urllib.parse import unquote

from voxsieve.plans.directory import (
    directory_results, open_files, process_directory, run_errors, run_log, unread_transcripts)
from voxsieve.registry import fixtures as fx
from voxsieve.sources.scratch import scratch_root


def put(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    segments = [{"start": float(i), "end": i + 1.0, "text": t} for i, t in enumerate(lines)]
    (folder / name).write_text(json.dumps({"text": " ".join(lines), "segments": segments}, indent=1))


def counts(row):
    return row.total, row.processed, row.skipped, row.failed


def test_directory_runs(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    put(source / "x", "a.json", "idiot scum trash moron")
    put(source / "y", "a.json", "good day to you", "and another one")
    (source / "y" / "cut.json").write_text('{"text": "idiot", "segments": [')

    def run():
        return process_directory(spark, str(source), target, fx.lexicon(spark)).first()

    assert counts(run()) == (3, 2, 0, 1)
    rows = {r.file: r for r in directory_results(spark, target).collect()}
    assert set(rows) == {"x/a.json", "y/a.json"} and all(r.valid for r in rows.values())
    assert [len(rows[f].segments) for f in ("x/a.json", "y/a.json")] == [1, 2]
    assert rows["x/a.json"].statistics.max_toxicity > rows["y/a.json"].statistics.max_toxicity
    assert rows["x/a.json"].full_text_classification.is_toxic and not rows["y/a.json"].full_text_classification.is_toxic
    assert rows["y/a.json"].segments[1].startTime == 1.0
    assert [(r.file, r.error_type) for r in run_errors(spark, target).collect()] == [("y/cut.json", "JSONDecodeError")]

    assert counts(run()) == (3, 0, 2, 1)
    put(source / "y", "cut.json", "mended")
    assert counts(run()) == (3, 1, 2, 0)
    assert sorted(r.file for r in directory_results(spark, target).collect()) == ["x/a.json", "y/a.json", "y/cut.json"]
    assert run_log(spark, target).select("run").distinct().count() == 3


def test_finished_files_are_not_opened(spark, tmp_path):
    source, target = tmp_path / "in [x]", str(tmp_path / "out")
    for name in ("a {1}.json", "b.json", "cut.json"):
        put(source, name, "good day")
    (source / "cut.json").write_text("{")
    process_directory(spark, str(source).replace("[", r"\[").replace("]", r"\]"), target, fx.lexicon(spark))
    place = str(source).replace("[", r"\[").replace("]", r"\]")
    put(source, "new*.json", "more words")
    log = run_log(spark, target)
    names = {r.name.rpartition("/")[2] for r in open_files(spark, place, log).collect()}
    assert names == {"cut.json", "new*.json"}
    opened = unread_transcripts(spark, place, log).inputFiles()
    assert {unquote(f).rpartition("/")[2] for f in opened} == names
    assert counts(process_directory(spark, place, target, fx.lexicon(spark)).first()) == (4, 1, 2, 1)
    (source / "cut.json").unlink()
    assert unread_transcripts(spark, place, run_log(spark, target)).inputFiles() == []
    assert counts(process_directory(spark, place, target, fx.lexicon(spark)).first()) == (3, 0, 3, 0)


def test_a_run_leaves_no_table_behind(spark, tmp_path):
    root = Path(scratch_root(spark).removeprefix("file:"))
    put(tmp_path / "in", "a.json", "good day")
    before = set(root.glob("*")) if root.exists() else set()
    process_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), fx.lexicon(spark))
    assert {p for p in set(root.glob("*")) - before if any(p.rglob("*"))} == set()


def test_empty_directory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert counts(process_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), fx.lexicon(spark)).first()) == (0, 0, 0, 0)
    assert directory_results(spark, str(tmp_path / "out")).count() == 0


def test_scorer_errors_are_kept(spark, tmp_path):
    put(tmp_path / "in", "a.json", "BAD", "fine words")

    def make():
        def scorer(texts):
            if "BAD" in texts:
                raise RuntimeError("cannot score")
            return [{"toxic": {"toxic": 0.9}} for _ in texts]
        return scorer

    target = str(tmp_path / "out")
    assert counts(process_directory(spark, str(tmp_path / "in"), target, fx.lexicon(spark), make_scorer=make).first()) == (1, 1, 0, 0)
    assert [(r.file, r.error_message) for r in run_errors(spark, target).collect()] == [("a.json", "cannot score")]
