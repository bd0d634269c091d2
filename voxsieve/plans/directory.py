"""A directory of transcripts scored into a directory of results, again and again."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.learning import Bundle
from ..operators.rollup import display_fields, json_envelope, run_summary
from ..operators.scorer import Scorer
from ..settings import DEFAULTS, Settings
from ..sources.media import listed_files, literal_path, skip_existing
from ..sources.results import write_results
from ..sources.scratch import run_folder, stored
from ..sources.transcripts import broken_transcripts, reload_results, transcript_files
from .recordings import document_scores, score_recordings

LOG = "file string, path string, status string, started_at timestamp, ended_at timestamp, run string"
ERRORS = "file string, file_type string, timestamp timestamp, error_type string, error_message string, run string"


def _runs(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """Rows of all runs below `path`; none before the first run."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_log(spark: SparkSession, target: str) -> DataFrame:
    """What became of each file in each finished run: processed, skipped or failed."""
    return _runs(spark, f"{target}/log", LOG, "parquet")


def run_errors(spark: SparkSession, target: str) -> DataFrame:
    """Error rows of files that cannot be parsed and of segments that the scorer failed on."""
    return _runs(spark, f"{target}/errors", ERRORS, "json")


def directory_results(spark: SparkSession, target: str) -> DataFrame:
    """The results of all finished runs, as reload_results reads them."""
    runs = [r.run for r in run_log(spark, target).select("run").distinct().collect()]  # a row per run
    paths = [f"{target}/results/run={r}/documents" for r in sorted(runs)]
    return reload_results(spark, paths, one_per_file=False, pattern="*.txt")


#: Files whose paths are handed to a reader; where more are open, the whole directory is read.
MOST_PATHS = 100_000


def finished_paths(log: DataFrame) -> DataFrame:
    """(path): input files of which some run left nothing to do again."""
    last = log.filter("path is not null").groupBy("path", "run").agg(F.count_if(F.col("status") == "failed").alias("failed"))
    return last.filter("failed = 0").select("path").distinct()


def open_files(spark: SparkSession, source: str, log: DataFrame, pattern: str = "*.json") -> DataFrame:
    """(path, name) of the files below `source` that no run has finished, from their names alone."""
    return listed_files(spark, source, pattern).join(
        finished_paths(log).withColumnRenamed("path", "name"), "name", "left_anti")


def unread_transcripts(spark: SparkSession, source: str, log: DataFrame, one_per_file: bool = True,
                       pattern: str = "*.json") -> DataFrame:
    """Rows of transcript_files of the open files; finished ones are not opened."""
    if log.isEmpty():
        return transcript_files(spark, source, one_per_file, pattern)
    paths = [r.path for r in open_files(spark, source, log, pattern).select("path").limit(MOST_PATHS + 1).collect()]
    if not paths:
        return spark.createDataFrame([], transcript_files(spark, source, one_per_file, pattern).schema)
    if len(paths) <= MOST_PATHS:
        return transcript_files(spark, source, one_per_file, pattern, [literal_path(p) for p in paths])
    return transcript_files(spark, source, one_per_file, pattern).join(finished_paths(log), "path", "left_anti")


def process_directory(spark: SparkSession, source: str, target: str, lexicon: DataFrame,
                      settings: Settings = DEFAULTS, make_scorer: Callable[[], Scorer] | None = None,
                      bundle: Bundle | None = None, one_per_file: bool = True,
                      pattern: str = "*.json") -> DataFrame:
    """Score the transcripts below `source` that have no result below `target`; returns the run's summary.

    Each run writes results, errors and, last, its log; only logged runs count, so a run that was
    cut off is done again as a whole. Files that failed are tried again by the next run; files that
    are finished are listed, not opened. Intermediate tables are removed at the end of the run.
    """
    target = target.rstrip("/")
    started = datetime.now(timezone.utc)
    run = f"run={started:%Y%m%dT%H%M%S%f}"
    with run_folder(spark):
        log = run_log(spark, target)
        done = log.filter("status = 'processed'").select("file", "path").distinct()
        files = stored(unread_transcripts(spark, source, log, one_per_file, pattern), "files", "zstd")
        # names meet the log; of what it holds already there is little, so the texts stay where they are
        names = files.select("file", "path")
        new = skip_existing(names, done, by_path=True).select("file").distinct()
        again = stored(names.join(new, "file", "left_anti"), "again")
        todo = skip_existing(files, again, by_path=True)
        good = todo.filter("error is null").drop("error")
        broken = broken_transcripts(todo)

        scored = score_recordings(good, lexicon, bundle=bundle, settings=settings, make_scorer=make_scorer, store=True)
        whole = document_scores(good, lexicon, settings, make_scorer)
        documents = json_envelope(scored.segments, scored.statistics, display_fields(), settings, whole)
        write_results(documents, scored.statistics, f"{target}/results/{run}")

        failures = broken
        if make_scorer is not None:
            failures = broken.unionByName(scored.segments.filter("error is not null").select(
                "file", F.lit("segment").alias("file_type"), F.current_timestamp().alias("timestamp"), "error.*"))
        failures.write.json(f"{target}/errors/{run}")

        ended = datetime.now(timezone.utc)
        listed = listed_files(spark, source, pattern).select(F.col("name").alias("path"))
        finished = done.join(listed, "path", "left_semi").join(finished_paths(log), "path", "left_semi")
        parts = {
            "processed": good.select("file", "path"), "failed": todo.filter("error is not null").select("file", "path"),
            "skipped": finished.unionByName(again)}
        statuses = reduce(DataFrame.unionByName, [df.withColumn("status", F.lit(name)) for name, df in parts.items()])
        statuses.withColumns({"started_at": F.lit(started), "ended_at": F.lit(ended)}).write.parquet(f"{target}/log/{run}")
    return run_summary(spark.read.schema(LOG).parquet(f"{target}/log/{run}"))
