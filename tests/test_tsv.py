"""Directories of TSV files: joined by name, split in file order."""

import pytest

from voxsieve.sources.tsv import split_tsv_dir, union_tsv_dir


@pytest.fixture
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "2000")
    yield
    spark.conf.set(name, before)


def contents(folder):
    return {p.name: p.read_text().splitlines() for p in folder.iterdir() if p.is_file() and not p.name.startswith(".")}


def test_parts_follow_the_file(spark, tmp_path, small_blocks):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    rows = [f"{i * 7919 % 1000}\tword {i}" for i in range(1000)]  # no column is in order
    (source / "big one+é.tsv").write_text("id\ttext\n" + "\n".join(rows) + "\n")
    (source / "even.TSV").write_text("a\tb\r\n" + "1\t2\r\n" * 300)
    (source / "head.tsv").write_text("a\tb\n")
    (source / "old.part3.tsv").write_text("a\n1\n")
    (source / "notes.txt").write_text("x")
    (source / "quote.tsv").write_text('a\tb\n1\t"two\nlines"\n')
    (source / "bytes.tsv").write_bytes(b"a\tb\n1\t\xff\xfe\n")
    done = {r.name: (r.status, r.n_rows, r.n_parts, r.error) for r in split_tsv_dir(spark, str(source), str(target), 300).collect()}
    assert done == {
        "big one+é.tsv": ("split", 1000, 4, None), "even.TSV": ("split", 300, 1, None), "head.tsv": ("empty", 0, 0, None),
        "old.part3.tsv": ("skipped", None, None, None), "notes.txt": ("skipped", None, None, None),
        "quote.tsv": ("failed", 2, None, "line break within quotes"), "bytes.tsv": ("failed", 1, None, "not UTF-8")}
    found = contents(target)
    assert set(found) == {f"big one+é.part{k}.tsv" for k in (1, 2, 3, 4)} | {"even.part1.tsv"}
    for k in range(4):
        assert found[f"big one+é.part{k + 1}.tsv"] == ["id\ttext", *rows[300 * k:300 * k + 300]]
    assert found["even.part1.tsv"] == ["a\tb"] + ["1\t2"] * 300
    # again, into the folder itself: parts are not split once more
    assert split_tsv_dir(spark, str(target), str(target), 10).filter("status <> 'skipped'").isEmpty()
    assert contents(target) == found


def test_files_with_other_columns(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("text\tlabel\nx\t1\n")
    (tmp_path / "c {1}.tsv").write_text("label\ttext\n0\ty\n")
    (tmp_path / "a.tsv").write_text('﻿id\ttext\n5\t"say ""no"""\n6\t\n')
    (tmp_path / "d.tsv").write_text("text\tlabel\nz\t1\n")
    (tmp_path / "other.csv").write_text("no\n1\n")
    df = union_tsv_dir(spark, str(tmp_path))
    assert df.columns == ["id", "text", "label"]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(
        [("5", 'say "no"', None), ("6", None, None), (None, "x", "1"), (None, "z", "1"), (None, "y", "0")], key=repr)
    (tmp_path / "e.tsv").write_text("a\ta\n1\t2\n")
    with pytest.raises(ValueError, match="repeated column"):
        union_tsv_dir(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no file"):
        union_tsv_dir(spark, str(tmp_path / "none"))
