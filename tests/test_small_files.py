"""Folders of many small files: the rows of Spark's reader, without its listing on the driver."""

import pytest
from pyspark.sql import functions as F

from voxsieve.sources.pairs import feature_files
from voxsieve.sources.small_files import files_of_folder


@pytest.fixture
def folder(tmp_path):
    for name in ("a_x.json", "deep/b é+%_x.json", "_hidden_x.json", ".dot_x.json", "_skip/c_x.json", "k=v/d_x.json", "_p=1/e_x.json", "other.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff{" if name == "a_x.json" else f'{{"n": "{name}"}}\n'.encode())
    (tmp_path / "zero_x.json").write_bytes(b"")
    return tmp_path


def test_same_files_as_sparks_reader(spark, folder):
    from voxsieve.sources.transcripts import path_below

    plain = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_x.json").text(str(folder), wholetext=True).select(
        path_below(str(folder)).alias("name"), F.hex("value").alias("value")).collect()
    for path in (str(folder), f"file://{folder}", f"{folder}/"):
        found = files_of_folder(spark, path, "_x.json").select("name", F.hex("value").alias("value")).collect()
        assert sorted(found) == sorted(plain) and len(found) == 4


def test_patterns_and_missing_folders_are_left_to_spark(spark, folder):
    assert files_of_folder(spark, f"{folder}/*", "_x.json") is None
    assert files_of_folder(spark, f"{folder}/a_x.json", "_x.json") is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        feature_files(spark, f"{folder}/nowhere")


def test_the_driver_lists_no_member_file(spark, folder):
    for members in feature_files(spark, str(folder)):
        assert members.inputFiles() == []
