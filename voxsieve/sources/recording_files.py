"""A sink that writes files named by their rows: a row is a file, or a line of one."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "recording_files"

#: Files whose names end so are written packed and read unpacked.
PACKED = ".gz"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that every executor reaches, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Packed:
    """A stream of gzip over another; the same content gives the same bytes."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.packer = out, zlib.compressobj(3, wbits=31)

    def write(self, content: bytes) -> None:
        self.out.write(self.packer.compress(content))

    def close(self) -> None:
        self.out.write(self.packer.flush())
        self.out.close()


def unpacked(content: bytes) -> bytes | None:
    """The content of a gzip file, which may be several after each other; None where it is damaged or cut off."""
    parts = []
    while content:
        unpacker = zlib.decompressobj(wbits=31)
        try:
            parts.append(unpacker.decompress(content))
        except zlib.error:
            return None
        if not unpacker.eof:
            return None
        content = unpacker.unused_data.lstrip(b"\0")
    return b"".join(parts)


@dataclass
class Written(WriterCommitMessage):
    files: int


class RecordingWriter(DataSourceArrowWriter):
    """Files are written aside and moved to their names when their task is done.

    A name follows from its row, so a task that is repeated puts the same files in the same places; what
    it had not finished lies in the job's own folder, which goes when the job is over.
    """

    def __init__(self, path: str, lines: bool = False):
        self.path = path.rstrip("/")
        self.lines = lines
        self.aside = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        _, aside = opened(self.aside)
        aside = f"{aside}/{TaskContext.get().taskAttemptId()}"
        names, out = [], None
        try:
            for batch in iterator:
                for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    if not (self.lines and names and names[-1] == name):
                        if not name or ".." in name.split("/"):
                            raise ValueError(f"no name for a file: {name!r}")
                        if out is None:
                            system.create_dir(aside, recursive=True)
                        else:
                            out.close()
                        out = system.open_output_stream(f"{aside}/{len(names)}", compression=None)
                        out = Packed(out) if name.endswith(PACKED) else out
                        names.append(name)
                    out.write((value or "").encode() + (b"\n" if self.lines else b""))
        finally:
            if out is not None:
                out.close()
        for folder in {f"{root}/{n}".rpartition("/")[0] for n in names}:
            system.create_dir(folder, recursive=True)
        for k, name in enumerate(names):
            system.move(f"{aside}/{k}", f"{root}/{name}")
        return Written(len(names))

    def _clear(self) -> None:
        system, aside = opened(self.aside)
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


class RecordingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(self.options["path"], self.options.get("lines") == "true")


def write_recording_files(rows: DataFrame, path: str) -> None:
    """A file below `path` for each row (name, value); a file that has the name already is replaced.

    Names are paths below `path` and unique; what is named .gz is packed. `path` is one that every executor reaches and that pyarrow opens
    (a mounted folder, s3, gs or hdfs).
    """
    rows.sparkSession.dataSource.register(RecordingFiles)
    rows.select("name", "value").write.format(FORMAT).mode("append").save(path)


def write_line_files(lines: DataFrame, order: str, path: str) -> None:
    """Files of lines: rows (name, value) of a name, by `order`, are the lines of one file, written by one task."""
    lines.sparkSession.dataSource.register(RecordingFiles)
    dealt = lines.repartition("name").sortWithinPartitions("name", order)
    dealt.select("name", "value").write.format(FORMAT).mode("append").option("lines", "true").save(path)
