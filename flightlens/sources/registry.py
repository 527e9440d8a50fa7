"""Readers by platform: an ordered registry that routes files to the reader that takes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.functions.rules import extension
from flightlens.operators import evidence
from flightlens.sources import binary, flight_logs

TELEMETRY = ("file", "seq", "ts", "latitude", "longitude", "altitude_m", "ground_speed_mps", "satellites_visible", "source_channel")


@dataclass(frozen=True)
class Reader:
    """A reader of one kind of file: where it applies, and how it reads a list of paths."""

    name: str
    platform: str
    extensions: tuple[str, ...]
    read: Callable[[SparkSession, list[str]], DataFrame]
    accepts: Callable[[Column, Column], Column] | None = None


def _dataflash(spark: SparkSession, paths: list[str]) -> DataFrame:
    return binary.dataflash_telemetry(binary.dataflash_messages(spark, paths))


def _radio(spark: SparkSession, paths: list[str]) -> DataFrame:
    return binary.radio_telemetry(binary.radio_messages(spark, paths))


@dataclass
class Registry:
    """Readers in the order they are tried."""

    readers: list[Reader] = field(
        default_factory=lambda: [
            Reader("srt", "dji", (".srt",), flight_logs.read_srt),
            Reader("flight_csv", "dji", (".csv", ".txt"), flight_logs.read_flight_csv),
            Reader("dat_text", "dji", (".dat",), flight_logs.read_dat_text),
            Reader("dataflash", "ardupilot", (".bin",), _dataflash),
            Reader("radio_log", "ardupilot", (".tlog",), _radio),
            Reader("ap_log", "ardupilot", (".log", ".txt"), flight_logs.read_ap_log),
            Reader("px4_csv", "px4", (".csv",), flight_logs.read_px4_csv),
            Reader("json_dump", "parrot", (".json", ".pud"), flight_logs.read_parrot_json),
            Reader("blackbox", "betaflight", (".bbl", ".txt", ".log", ".csv"), flight_logs.read_blackbox),
        ]
    )

    def register(self, reader: Reader) -> None:
        """Adds a reader behind the others."""
        self.readers.append(reader)

    def table(self, spark: SparkSession) -> DataFrame:
        """The readers as rows, in order."""
        return spark.createDataFrame([(i, r.name, r.platform, list(r.extensions)) for i, r in enumerate(self.readers)], "pos int, name string, platform string, extensions array<string>")

    def route(self, path: Column, head: Column) -> Column:
        """The name of the first reader that takes a file; null if none does."""
        platform, chosen = evidence.detect_platform(path, head), None
        for reader in self.readers:
            takes = (platform == reader.platform) & extension(path).isin(*reader.extensions)
            if reader.accepts:
                takes = reader.accepts(path, head)
            chosen = F.when(takes, F.lit(reader.name)) if chosen is None else chosen.when(takes, F.lit(reader.name))
        return chosen

    def read_all(self, spark: SparkSession, path: str) -> DataFrame:
        """Telemetry of every file below path that a reader takes; (file, seq) keeps each file's order.

        Only names and first bytes are looked at to route; the list of paths, one per
        file, goes through the driver as it does for any Spark read of a list of paths.
        """
        routed = binary.heads(spark, path).select("path", self.route(F.col("path"), evidence.head_text(F.col("head"))).alias("reader"))
        paths: dict[str, list[str]] = {}
        for row in routed.filter(F.col("reader").isNotNull()).collect():
            paths.setdefault(row.reader, []).append(row.path)
        parts = [r.read(spark, sorted(paths[r.name])).select(*TELEMETRY) for r in self.readers if r.name in paths]
        if not parts:
            return spark.createDataFrame([], "file string, seq long, ts timestamp, latitude double, longitude double, altitude_m double, ground_speed_mps double, satellites_visible int, source_channel string")
        return reduce(DataFrame.unionByName, parts)


def append_case(telemetry: DataFrame, case_id: int, files: DataFrame) -> DataFrame:
    """Telemetry of several files as one case: files keep the order of `files` (file, ingest_seq)."""
    return telemetry.join(files.select("file", "ingest_seq"), "file").withColumn("case_id", F.lit(case_id)).withColumnRenamed("file", "evidence_id")


def new_evidence(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content hash is not among those known: a repeated ingest adds nothing."""
    return files.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")
