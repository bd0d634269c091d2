"""Folders of very many small files, listed and read by tasks.

Spark's readers list every file on the driver, about a kilobyte of it each, and deal out a few dozen files per task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .recording_files import PACKED, opened, unpacked

#: File systems that pyarrow opens as Spark does.
SCHEMES = ("file", "hdfs", "s3", "gs")
#: Names of a batch of the listing, and bytes after which a batch of contents is handed on.
NAMES, BYTES = 10_000, 8_000_000


def _folder(spark: SparkSession, path: str) -> str | None:
    """The path with its scheme, if it is a folder on one of SCHEMES and no pattern."""
    if re.search(r"[*?\[\]{}\\]", path):
        return None
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    if path.partition(":")[0] not in SCHEMES:
        return None
    system, root = opened(path)
    return path if system.get_file_info(root).type == fs.FileType.Directory else None


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and bytes of all in a folder."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir():
                    yield e.name, True, 0
                elif e.is_file():
                    yield e.name, False, e.stat().st_size
    else:
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _walk(system: fs.FileSystem, root: str, suffix: str) -> Iterator[str]:
    """Paths below `root` of the files with the suffix, packed or not, that hold anything."""
    below = [""]
    while below:
        folder = below.pop()
        for name, is_folder, size in _entries(system, f"{root}/{folder}".rstrip("/")):
            if _hidden(name):
                continue
            if is_folder:
                below.append(f"{folder}{name}/")
            elif size > 0 and name.removesuffix(PACKED).endswith(suffix):
                yield f"{folder}{name}"


def files_of_folder(spark: SparkSession, path: str, suffix: str) -> DataFrame | None:
    """(name, value): path below the folder and whole content of its files with the suffix, or None where tasks cannot list it.

    One task walks the folder and hands on names; the files are dealt over the tasks that read them. Files may be packed,
    as <name>.gz; a packed file that is damaged has a null value.
    """
    place = _folder(spark, path)
    if place is None:
        return None

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, root = opened(place)
            names: list[str] = []
            for name in _walk(system, root.rstrip("/"), suffix):
                names.append(name)
                if len(names) == NAMES:
                    yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})
                    names = []
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(place)
        for batch in batches:
            names, values, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root.rstrip('/')}/{name}", compression=None) as f:
                    values.append(unpacked(f.read()) if name.endswith(PACKED) else f.read())
                names.append(name)
                held += len(values[-1] or b"")
                if held > BYTES:
                    yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "value": pa.array(values, pa.binary())})
                    names, values, held = [], [], 0
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "value": pa.array(values, pa.binary())})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = spark.range(1, numPartitions=1).mapInArrow(listed, "name string").repartition(tasks, "name")
    return names.mapInArrow(read, "name string, value binary").selectExpr("name", "CAST(value AS string) AS value")
