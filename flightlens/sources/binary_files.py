"""A sink for binary files: rows (file, ord, data) become one file each name, its pieces in order.

    sinks: pieces.repartition("file").sortWithinPartitions("file", "ord").write.format("binary_files").option("path", folder).mode("append").save()

Each task streams the files of its partition to names of its own; only when the job commits do
they get theirs, so a task that is run twice, or lost with its executor, leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a Spark path, and the path in it."""
    if urlsplit(path).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (temporary name, name)."""

    files: list[tuple[str, str]]


class BinaryWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Written:
        system, folder = file_system(self.folder)
        system.create_dir(f"{folder}/_temporary", recursive=True)
        done: list[tuple[str, str]] = []
        name, out = None, None
        for file, data in ((row["file"], row["data"]) for row in iterator):
            if file != name:
                if out is not None:
                    out.close()
                name = file
                done.append((f"{folder}/_temporary/{uuid.uuid4().hex}", f"{folder}/{file}"))
                out = system.open_output_stream(done[-1][0])
            out.write(bytes(data))
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.folder)
        system.create_dir(folder, recursive=True)
        for message in messages:
            for temporary, name in message.files if message else ():
                system.create_dir(name.rpartition("/")[0], recursive=True)
                system.move(temporary, name)
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, system: pyarrow.fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/_temporary").type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(f"{folder}/_temporary")


class BinaryFiles(DataSource):
    """The sink as a data source; its one option is path."""

    @classmethod
    def name(cls) -> str:
        return "binary_files"

    def schema(self) -> str:
        return "file string, ord long, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> BinaryWriter:
        return BinaryWriter(self.options["path"])


def write_files(pieces: DataFrame, folder: str) -> str:
    """Writes pieces (file, ord, data) below folder; a file's pieces pass through one task, a piece at a time."""
    spark: SparkSession = pieces.sparkSession
    spark.dataSource.register(BinaryFiles)
    ordered = pieces.select("file", F.col("ord").cast("long").alias("ord"), "data").repartition("file").sortWithinPartitions("file", "ord")
    ordered.write.format("binary_files").option("path", folder).mode("append").save()
    return folder
