"""A folder for intermediate tables that every executor can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_run: ContextVar[str | None] = ContextVar("run", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or its warehouse where that is not set.

    A warehouse on the machine's own disk is no place for tables of a cluster: there the setting is called for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        local = root.startswith(("file:", "/"))
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{root}/scratch"
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """Fresh path in the current run's folder, or else in the shared folder, for the cluster to clear."""
    return f"{_run.get() or scratch_root(spark)}/voxsieve-{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are gone afterwards; for jobs that leave no plan that reads them."""
    path = scratch_dir(spark, "run")
    token = _run.set(path)
    try:
        yield
    finally:
        _run.reset(token)
        delete_path(spark, path)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The rows as a written table: computed once, read by every later step, safe from executor loss.

    `codec` packs tables of whole texts tighter than the session's own would.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
