"""A sink of named files: lines of a table go to the very paths that the table names, all of them or none."""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def place(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote under other names: (name now, name wanted)."""

    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceArrowWriter):
    """Each task writes the files whose lines it gets, one after another, under names that no reader takes; when all tasks are done, the
    driver gives them their own. A task that fails takes its files away, and so does the driver with those of a job that fails."""

    def __init__(self) -> None:
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str, str]] = []
        out, now = None, None
        try:
            for batch in batches:
                paths, values = batch.column("path").to_pylist(), batch.column("value").to_pylist()
                for path, value in zip(paths, values, strict=True):
                    if path != now:
                        if out is not None:
                            out.close()
                        system, at = place(path)
                        folder, name = posixpath.split(at)
                        system.create_dir(folder, recursive=True)
                        other = f"{folder}/.{name}.{self.job}.{uuid.uuid4().hex}"
                        done.append((path, other))
                        out, now = system.open_output_stream(other, compression="gzip" if path.endswith(".gz") else None), path
                    if value is not None:
                        out.write(value.encode() + b"\n")
            if out is not None:
                out.close()
            return Written(done)
        except BaseException:
            if out is not None:
                out.close()
            _removed(done)
            raise

    def commit(self, messages: list[Written | None]) -> None:
        folders = set()
        for message in messages:
            for path, other in message.files if message else ():
                system, at = place(path)
                system.move(other, at)
                folders.add(posixpath.split(path)[0])
        self._swept(folders)

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            _removed(message.files if message else [])

    def _swept(self, folders: set[str]) -> None:
        """Takes away what attempts that were killed have left."""
        for folder in folders:
            system, at = place(folder)
            for info in system.get_file_info(fs.FileSelector(at)):
                if self.job in info.base_name and info.base_name.startswith("."):
                    system.delete_file(info.path)


def _removed(files: list[tuple[str, str]]) -> None:
    for path, other in files:
        system = place(path)[0]
        if system.get_file_info(other).type != fs.FileType.NotFound:
            system.delete_file(other)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexiloom_named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter()


def write_named(rows: DataFrame, *order: Column | str) -> None:
    """Writes rows (path, value, ...) as one text file for each path, a line for each value in `order`; a path that ends in .gz is
    compressed; a null value makes a file but no line. Files appear when all are complete, and replace older ones.

    Paths are dealt over the tasks. A file is written by one task as a stream, whatever its size: one file is one writer.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    sorted_rows = rows.repartition("path").sortWithinPartitions("path", *order)
    sorted_rows.select(F.col("path").cast("string").alias("path"), F.col("value").cast("string").alias("value")).write.format("lexiloom_named_files").mode("append").save()
