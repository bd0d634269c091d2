"""Incremental forms of the batch jobs, as Structured Streaming file jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.recordings import score_recordings
from ..settings import DEFAULTS, Settings
from ..sources.media import literal_path, skip_existing
from ..sources.transcripts import broken_transcripts, parse_transcripts, path_below, transcript_files


def transcript_stream(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """New transcript files as they appear, as rows of transcript_files."""
    raw = spark.readStream.option("pathGlobFilter", "*.json").text(path, wholetext=one_per_file)
    return parse_transcripts(raw, path, one_per_file)


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything not yet processed, then stop; the checkpoint remembers what was done."""
    return (
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(handle).start()
    )


def score_new_transcripts(spark: SparkSession, source: str, sink: str, checkpoint: str, lexicon: DataFrame,
                          settings: Settings = DEFAULTS) -> StreamingQuery:
    """Recording statistics of new transcripts, one directory per batch so a replayed batch overwrites itself.

    Transcripts that cannot be parsed become error rows below `<sink>_errors`.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        broken_transcripts(batch).write.mode("overwrite").json(f"{sink.rstrip('/')}_errors/batch={batch_id}")
        statistics = score_recordings(batch.filter("error is null"), lexicon, settings=settings).statistics
        statistics.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return run_available(transcript_stream(spark, source), checkpoint, handle)


#: Columns of a listing; the content is not among those that are read.
LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def score_open_transcripts(spark: SparkSession, source: str, sink: str, checkpoint: str, lexicon: DataFrame, done: DataFrame,
                           files_per_batch: int = 10_000, settings: Settings = DEFAULTS) -> StreamingQuery:
    """score_new_transcripts for a directory in which some files have results from elsewhere.

    `done` (file) names those by their path below `source`. The stream is the listing alone; of each batch the files
    without a result are opened, `files_per_batch` at most.
    """
    listing = (
        spark.readStream.schema(LISTING).format("binaryFile").option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_batch).load(source).select("path", path_below(source).alias("name"))
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        paths = [literal_path(r.path) for r in skip_existing(batch, done.select(F.col("file").alias("name")), "name", by_path=True).collect()]
        if not paths:
            return
        files = transcript_files(spark, source, only=paths)
        broken_transcripts(files).write.mode("overwrite").json(f"{sink.rstrip('/')}_errors/batch={batch_id}")
        statistics = score_recordings(files.filter("error is null"), lexicon, settings=settings).statistics
        statistics.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return run_available(listing, checkpoint, handle)
