"""Files of given names, written by tasks: each under a name of its own first, all renamed once every task has ended.

``df.write.format("named_files").mode("append").option("path", folder).save()`` takes ``name string, content binary``. Files are
reached by ``pyarrow.fs`` (local, S3, GCS, Azure), from executors as from the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


#: Schemes of paths that tasks can open by themselves; others only Spark's own readers reach.
OPENED = ("", "file", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def opened_by_tasks(path: str) -> bool:
    return (path.split(":", 1)[0] if ":" in path.split("/", 1)[0] + "/" else "") in OPENED


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: temporary and final paths."""

    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = file_system(self.folder)
        files = []
        for batch in iterator:
            for name, content in zip(batch.column(0), batch.column(1)):
                goal = f"{base}/{name.as_py()}"
                folder, leaf = os.path.split(goal)
                system.create_dir(folder, recursive=True)
                part = f"{folder}/.{leaf}.{uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                files.append((part, goal))
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        goals = [goal for _, goal in files]
        if len(set(goals)) < len(goals):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        system = file_system(self.folder)[0]
        for part, goal in files:
            system.move(part, goal)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system = file_system(self.folder)[0]
        for part, _ in (f for m in messages if m for f in m.files):
            system.delete_file(part)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: object, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def save_files(contents: DataFrame, name_col: str, folder: str) -> DataFrame:
    """Writes each row's ``content`` as ``folder/name``, in tasks; a file of that name is replaced. Returns the names.

    No file has its name before all are written. Two rows of one name are an error, and nothing is written.
    """
    spark = contents.sparkSession
    spark.dataSource.register(NamedFiles)
    contents.select(F.col(name_col).alias("name"), "content").write.format("named_files").mode("append").option("path", folder).save()
    return contents.select(F.col(name_col).alias("name"))


def save_lines(lines: DataFrame, folder: str) -> None:
    """``(path, n, line)`` as text files ``folder/path``, each of a path's lines in their order; a file's lines are held by one task."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    text = lines.groupBy(F.col("path").alias("name")).agg(F.encode(F.concat(joined, F.lit("\n")), "UTF-8").alias("content"))
    save_files(text, "name", folder)
