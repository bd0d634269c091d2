"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.features import ACOUSTIC
from ..functions.text import file_stem
from ..settings import TOXIC_LABELS
from .recording_files import write_recording_files


def write_results(documents: DataFrame, statistics: DataFrame, path: str, per_recording: bool = False) -> None:
    """JSON documents, as reload_results reads them, and a CSV of statistics below `path`.

    The combined layout (one document per line) suits many recordings; per_recording makes one file
    per recording, <name>-result.json in the recording's folder, and <name>-result.part<n>.json for
    what goes beyond a document.
    """
    if per_recording:
        part = F.when(F.col("part") > 0, F.concat(F.lit(".part"), F.col("part").cast("string"))).otherwise(F.lit(""))
        named = F.concat(file_stem(F.col("file")), F.lit("-result"), part, F.lit(".json"))
        write_recording_files(documents.select(named.alias("name"), F.col("document").alias("value")), f"{path}/documents")
    else:
        documents.select("document").write.mode("overwrite").text(f"{path}/documents")
    statistics.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{path}/summary")


def feature_dump(df: DataFrame) -> DataFrame:
    """Label, acoustic (inton_*), overall toxicity and toxic_* columns of engineered rows."""
    toxic = F.col("model_outputs.toxic")
    return df.select(
        "label", F.col("emotion").alias("inton_emotion"), *[F.col(c).alias(f"inton_{c}") for c in ACOUSTIC],
        F.col("overall_toxicity").alias("tox_overall"),
        *[F.coalesce(F.try_element_at(toxic, F.lit(name)), F.lit(0.0)).alias(f"toxic_{name}") for name in TOXIC_LABELS])


def dump_features(df: DataFrame, path: str) -> None:
    feature_dump(df).write.mode("overwrite").option("header", True).csv(path)
