"""A streaming source of the frames of radio logs that land and grow.

An offset is the length of every file. A batch reads what was added to each, cut into ranges;
a frame belongs to the batch and range in which it ends, so one whose end hasn't been written
waits, and none comes twice. Where frames begin is found from the bytes before (sources.ranges).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from flightlens.sources import binary, ranges
from flightlens.sources.binary_files import file_system

SCHEMA = f"file string, off long, {binary.RADIO_FIELDS}"


@dataclass
class Added(InputPartition):
    """Bytes of a file that a task takes the frames' ends from."""

    path: str
    start: int
    stop: int


def frames_that_end(framing: ranges.Framing, read, start: int, stop: int) -> Iterator[tuple]:
    """(off, ...) of the frames that end behind start and not behind stop, of a file that is stop long."""
    from_ = max(framing.first, start - framing.longest)
    at = framing.first if from_ == framing.first else ranges.entry(framing, read, from_, stop)
    if at is None:
        return
    data, place = read(at, stop), 0
    while place is not None and at + place < stop:
        following, frame = framing.step(data, place, at)
        if frame is not None and following is not None and start < at + following <= stop:
            yield at + frame[0], *frame[1:]
        place = following


class RadioStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, folder = file_system(self.path)
        found = system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True, recursive=True))
        return {f.path: f.size for f in found if f.type == pyarrow.fs.FileType.File and "/_" not in f.path and "/." not in f.path}

    def partitions(self, start: dict, end: dict) -> list[Added]:
        return [Added(path, a, min(a + self.size, length)) for path, length in sorted(end.items()) for a in range(start.get(path, 0), length, self.size)]

    def read(self, partition: Added) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as opened:

            def read(a: int, b: int) -> bytes:
                opened.seek(a)
                return opened.read(max(0, min(b, partition.stop) - a))

            for frame in frames_that_end(binary.Radio(), read, partition.start, partition.stop):
                yield partition.path, *frame

    def commit(self, end: dict) -> None:
        pass


class RadioLogs(DataSource):
    """format("radio_log_frames"): path, and rangeBytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "radio_log_frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> RadioStreamReader:  # noqa: N802
        return RadioStreamReader(self.options["path"], int(self.options.get("rangeBytes", ranges.RANGE_BYTES)))


def stream_radio_frames(spark: SparkSession, path: str, size: int = ranges.RANGE_BYTES) -> DataFrame:
    """(file, off, us, msg_id, numbers, text) of frames as the files below path land and grow."""
    spark.dataSource.register(RadioLogs)
    return spark.readStream.format("radio_log_frames").option("rangeBytes", str(size)).load(path)
