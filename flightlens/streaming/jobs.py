"""Structured Streaming forms of the operators, over tables that arrive as files.

Each transformation takes a streaming DataFrame and returns one; run_* drive a table
through it once with an available-now trigger and return what was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from flightlens.functions.geo import EARTH_RADIUS_M, off_null_island
from flightlens.operators.geofence import zone_matches
from flightlens.plans import views
from flightlens.session import shared_dir
from flightlens.sources import binary, ranges, zones

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
GAP_SCHEMA = "case_id long, seq long, anomaly_type string, ts timestamp, gap_sec double"
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: Files of a delivery, and deliveries of a month.
FILES_EACH, BATCHES = 2, 4
#: Rows of a pack, and rows that a task holds at most before it gives their packs.
PACK_ROWS, HELD_ROWS = 2_000, 500_000
GAP_STATE = "us long, latitude double, longitude double"


def stream_geofence(telemetry: DataFrame, zone_table: DataFrame) -> DataFrame:
    """Breaches of arriving points; zones are a static side, so nothing is kept."""
    return zone_matches(telemetry, zone_table).select("case_id", "seq", "zone_id", "ts")


class Gaps(StatefulProcessor):
    """Neighbour tests of one case: the last row is all that is kept between batches.

    Shuffled rows of a batch come in no order, so a batch's rows of a case are held as numbers
    (40 bytes each) and sorted. A row without a time has no gap before or behind it, one without
    a position no step, as in the batch operator.
    """

    def __init__(self, gap_seconds: float, jump_mps: float) -> None:
        self.gap_seconds, self.jump_mps = gap_seconds, jump_mps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", GAP_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(b["seq"].to_numpy("int64"), b["ts"].notna().to_numpy(), b["ts"].astype("datetime64[us]").astype("int64").to_numpy(), b["latitude"].to_numpy(float), b["longitude"].to_numpy(float)) for b in rows]
        seq, known, us, lat, lon = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(seq, kind="stable")
        seq, known, us, lat, lon = (x[order] for x in (seq, known, us, lat, lon))
        if self.last.exists():
            u, a, b = self.last.get()
            seq, known, us = np.r_[-1, seq], np.r_[u is not None, known], np.r_[u or 0, us]
            lat, lon = (np.r_[np.nan if x is None else x, xs] for x, xs in ((a, lat), (b, lon)))
        self.last.update((int(us[-1]) if known[-1] else None, *(None if np.isnan(x[-1]) else float(x[-1]) for x in (lat, lon))))
        gap = np.where(known[:-1] & known[1:], np.diff(np.where(known, us, 0)) / 1e6, np.nan)
        p, q = np.radians(lat[:-1]), np.radians(lat[1:])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(np.diff(lon)) / 2) ** 2
        step = 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0, 1 - h)))
        speed = np.divide(step, gap, out=np.zeros_like(step), where=gap > 0)
        for mask, kind, shift in ((gap < 0, "CLOCK_SKEW", 1), (gap > self.gap_seconds, "TIMESTAMP_GAP", 0), (speed > self.jump_mps, "GPS_DISCORDANCE", 1)):
            i = np.flatnonzero(mask)
            yield pd.DataFrame({"case_id": key[0], "seq": seq[i + 1], "anomaly_type": kind, "ts": pd.to_datetime(us[i + shift], unit="us"), "gap_sec": gap[i]})

    def close(self) -> None:
        pass


def stream_gaps(telemetry: DataFrame, gap_seconds: float = 5.0, jump_mps: float = 60.0) -> DataFrame:
    """Gaps, reversals and jumps between rows as they arrive; per case only the last row is kept.

    Arrival order is the signal, so there is no watermark and no sorting across batches; rows of
    one batch are taken in seq order. Needs the RocksDB state store, which run_once sets.
    """
    rows = telemetry.select("case_id", "seq", "ts", "latitude", "longitude")
    return rows.groupBy("case_id").transformWithStateInPandas(Gaps(gap_seconds, jump_mps), GAP_SCHEMA, "Append", "None")


def stream_summary(telemetry: DataFrame) -> DataFrame:
    """Running totals per case, in update or complete mode."""
    return telemetry.groupBy("case_id").agg(F.count("*").alias("points"), F.max("altitude_m").alias("max_altitude_m"), F.max("ground_speed_mps").alias("max_speed_mps"))


def _spread(media: DataFrame, telemetry: DataFrame, seconds: int, padding: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Media rows once for each stretch of time (bucket) they reach, and points with their own."""
    latest = max(seconds, longest + padding)
    span = F.lit(max(seconds, padding, longest // 16) * 1_000_000)
    length = F.coalesce("duration_sec", F.lit(0.0))
    before, after = F.when(length > 0, padding).otherwise(seconds), F.when(length > 0, F.least(length + padding, F.lit(float(latest)))).otherwise(seconds)
    place = lambda moved: F.floor((F.unix_micros("ts") + moved * 1_000_000) / span)
    return media.withColumn("bucket", F.explode(F.sequence(place(-before), place(F.ceil(after))))), telemetry.withColumn("bucket", place(F.lit(0)))


def _with_duration(media: DataFrame) -> DataFrame:
    return media if "duration_sec" in media.columns else media.withColumn("duration_sec", F.lit(None).cast("double"))


def _near(past: Column, duration: str, seconds: int, padding: int) -> Column:
    """Whether a point so many seconds past a media row belongs to it."""
    length = F.coalesce(duration, F.lit(0.0))
    return F.when(length > 0, (past >= -padding) & (past <= length + padding)).otherwise(F.abs(past) <= seconds)


def stream_media_match(media: DataFrame, telemetry: DataFrame, seconds: int = 60, padding: int = 15, longest: int = 7_200, delay: str = "10 minutes") -> DataFrame:
    """Media rows with the points of their case they belong to; both sides forget rows behind the watermark.

    An image (no duration_sec) takes the points within `seconds` of it, a video those inside
    its interval and `padding` seconds around it. How long state is kept follows from
    `longest`, the seconds a video may last at most; a longer one takes the points up to there.
    Rows meet by case and stretch of time: a media row goes to each stretch it reaches, a point to its own.
    """
    latest = max(seconds, longest + padding)
    m, t = _spread(_with_duration(media).withWatermark("ts", delay), telemetry.withWatermark("ts", delay), seconds, padding, longest)
    m, t = m.alias("m"), t.alias("t")
    reach = F.expr(f"t.ts between m.ts - interval {max(seconds, padding)} seconds and m.ts + interval {latest} seconds")
    past = (F.unix_micros("t.ts") - F.unix_micros("m.ts")) / F.lit(1e6)
    met = m.join(t, (F.col("m.case_id") == F.col("t.case_id")) & (F.col("m.bucket") == F.col("t.bucket")) & reach).filter(_near(past, "m.duration_sec", seconds, padding))
    return met.select(F.col("m.case_id").alias("case_id"), "m.media_id", F.col("m.ts").alias("capture_ts"), "t.seq", F.col("t.ts").alias("point_ts"))


def _packed(rows: DataFrame, name: str, kind: str) -> DataFrame:
    """(case_id, bucket, name): the other columns of a batch's rows, of this kind, in packs of up to PACK_ROWS of one case and stretch."""
    given = f"case_id long, bucket long, {name} array<struct<{kind}>>"
    kinds = to_arrow_schema(StructType.fromDDL(given))

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([("case_id", "ascending"), ("bucket", "ascending")]).combine_chunks()
        keys = [table[c].to_numpy() for c in ("case_id", "bucket")]
        at = np.arange(table.num_rows)
        first = np.r_[True, (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)]
        starts = np.flatnonzero((at - np.maximum.accumulate(np.where(first, at, 0))) % PACK_ROWS == 0)
        inner = kinds.field(name).type.value_type
        items = pa.StructArray.from_arrays([table[f.name].combine_chunks().cast(f.type) for f in inner], fields=list(inner))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, table.num_rows], pa.int32()), items)
        return pa.RecordBatch.from_arrays([pa.array(keys[0][starts], pa.int64()), pa.array(keys[1][starts], pa.int64()), lists.cast(kinds.field(name).type)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD_ROWS:
                yield packs(held)
                held, count = [], 0
        if count:
            yield packs(held)

    return rows.filter("case_id is not null and bucket is not null").repartition("case_id", "bucket").mapInArrow(run, given)


def stream_media_blocks(media: DataFrame, telemetry: DataFrame, seconds: int = 60, padding: int = 15, longest: int = 7_200) -> DataFrame:
    """(case_id, media, points): packs of media rows and of points whose case and stretch of time are the same, for `media_pairs`.

    stream_media_match for streams in which no row is too late, so that there is no watermark and
    all rows are kept. State and sink hold packs, so they grow with the rows and not with the
    pairs, and a pair costs no look into the state.
    """
    m, t = _spread(_with_duration(media), telemetry, seconds, padding, longest)
    m = _packed(m.select("case_id", "bucket", "media_id", F.unix_micros("ts").alias("us"), "duration_sec"), "media", "media_id long, us long, duration_sec double").alias("m")
    t = _packed(t.select("case_id", "bucket", "seq", F.unix_micros("ts").alias("us")), "points", "seq long, us long").alias("t")
    return m.join(t, (F.col("m.case_id") == F.col("t.case_id")) & (F.col("m.bucket") == F.col("t.bucket"))).select("m.case_id", "media", "points")


def media_pairs(blocks: DataFrame, seconds: int = 60, padding: int = 15, longest: int = 7_200) -> DataFrame:
    """The rows of stream_media_match that blocks hold, each once: a point is in the packs of one stretch."""
    each = blocks.select("case_id", F.explode("media").alias("m"), "points").select("case_id", "m", F.explode("points").alias("t"))
    past = (F.col("t.us") - F.col("m.us")) / F.lit(1e6)
    met = each.filter(past.between(-max(seconds, padding), max(seconds, longest + padding)) & _near(past, "m.duration_sec", seconds, padding))
    return met.select("case_id", "m.media_id", F.timestamp_micros("m.us").alias("capture_ts"), "t.seq", F.timestamp_micros("t.us").alias("point_ts"))


def stream_dedupe(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Files whose hash has not come within the watermark."""
    return files.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["sha256"])


def stream_windows(telemetry: DataFrame, length: str = "60 seconds", every: str = "45 seconds", delay: str = "10 minutes") -> DataFrame:
    """Time windows of points per case: the clock's analogue of the windows of 60 rows; late rows are dropped."""
    grouped = telemetry.withWatermark("ts", delay).groupBy("case_id", F.window("ts", length, every).alias("w"))
    return grouped.agg(F.count("*").alias("samples"), F.max("altitude_m").alias("max_altitude_m"), F.avg("ground_speed_mps").alias("avg_speed_mps")).select("case_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "samples", "max_altitude_m", "avg_speed_mps")


def stream_flights(telemetry: DataFrame, gap: str = "5 seconds", delay: str = "10 minutes") -> DataFrame:
    """Flights: runs of points of a case no further apart than `gap`."""
    grouped = telemetry.withWatermark("ts", delay).groupBy("case_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("points")).select("case_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "points")


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    """Positions of radio logs as their files land; each file is framed once, when it arrives."""
    landed = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(BINARY_SCHEMA).load(path)
    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *f) for f in ranges.file_at_once(binary.Radio(), bytes(content))], columns=["file", "off", "us", "msg_id", "numbers", "text"])

    frames = landed.select("path", "content").mapInPandas(framed, f"file string, off long, {binary.RADIO_FIELDS}")
    value = lambda name: F.element_at("numbers", name)
    rows = frames.filter(F.col("msg_id") == binary.POSITION).select(
        "file", F.col("off").alias("seq"), F.timestamp_micros("us").alias("ts"), (value("lat") / 1e7).alias("latitude"), (value("lon") / 1e7).alias("longitude"), F.round(value("rel_alt") / 1000, 2).alias("altitude_m")
    )
    return rows.filter(off_null_island(F.col("latitude"), F.col("longitude"), 0.001))


# ---------------------------------------------------------------- one-shot runs


def read_arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    static = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(static.schema).parquet(f"{sf_dir}/{name}.parquet*")


class _Arriving:
    """Lets the views read a table as a stream."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    @property
    def read(self) -> _Arriving:
        return self

    def parquet(self, path: str) -> DataFrame:
        folder, _, name = path.rpartition("/")
        return read_arriving(self.spark, folder, name.removesuffix(".parquet"))


def arriving_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.telemetry(_Arriving(spark), sf_dir)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything there is through a stream, then its output as a table."""
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "append":
        writer.format("parquet").start(f"{base}/out").awaitTermination()
    else:

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        writer.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def delivered(rows: DataFrame, batch: Column, count: int) -> DataFrame:
    """rows as a stream of `count` batches: those with batch k arrive k-th, in FILES_EACH files."""
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/arrivals/{uuid.uuid4().hex}"
    for k in range(count):
        part = rows.filter(batch == k).repartition(FILES_EACH)
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_EACH).parquet(path)


def _batches(rows: DataFrame, late: Column) -> tuple[DataFrame, Column]:
    """Telemetry-like rows in four batches by the day of the month, and those that are `late` in the last."""
    return rows, F.when(late, BATCHES - 1).otherwise(F.least(F.lit(BATCHES - 1), F.floor((F.dayofmonth("ts") - 1) / 8))).cast("int")


def run_late_windows(spark: SparkSession, sf_dir: str, delay: str) -> DataFrame:
    """Windows of a day that close behind the watermark; every 89th row comes with the last batch."""
    return run_once(stream_windows(delivered(*_batches(views.telemetry(spark, sf_dir), F.col("seq") % 89 == 0), BATCHES), "1 day", "1 day", delay))


def run_late_flights(spark: SparkSession, sf_dir: str, gap: str, delay: str) -> DataFrame:
    """Flights that close behind the watermark; every 89th row of the first days comes with the last batch."""
    late = (F.col("seq") % 89 == 0) & (F.dayofmonth("ts") < 9)
    return run_once(stream_flights(delivered(*_batches(views.telemetry(spark, sf_dir), late), BATCHES), gap, delay))


def run_late_media(spark: SparkSession, sf_dir: str, seconds: int, delay: str) -> DataFrame:
    """Media and points in four batches each; every 7th media row and 11th point comes with the last."""
    media = delivered(*_batches(views.media(spark, sf_dir), F.col("media_id") % 7 == 0), BATCHES)
    track = delivered(*_batches(views.track(spark, sf_dir), F.col("seq") % 11 == 0), BATCHES)
    return run_once(stream_media_match(media, track, seconds, longest=3_600, delay=delay))


def run_late_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that arrive on six days, by their id; what came within the watermark is left out."""
    day = F.pmod("doc_id", F.lit(6)).cast("int")
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.timestamp_seconds(F.lit(1_704_067_200) + day * 86_400).alias("arrived"), day.alias("day"))
    return run_once(stream_dedupe(delivered(files, F.col("day"), 6)))


def run_geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(stream_geofence(arriving_telemetry(spark, sf_dir), zones.zone_catalog(spark))).select("case_id", "seq", "zone_id")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(stream_summary(arriving_telemetry(spark, sf_dir)), "complete")


def run_gaps(spark: SparkSession, sf_dir: str, gap_seconds: float, jump_mps: float) -> DataFrame:
    return run_once(stream_gaps(arriving_telemetry(spark, sf_dir), gap_seconds, jump_mps))


def run_windows(spark: SparkSession, sf_dir: str, length: str, every: str) -> DataFrame:
    return run_once(stream_windows(arriving_telemetry(spark, sf_dir), length, every), "complete")


def run_flights(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    return run_once(stream_flights(arriving_telemetry(spark, sf_dir), gap), "complete")


def run_media_match(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    # Table order is not time order, so nothing may be forgotten for being late.
    blocks = run_once(stream_media_blocks(views.media(_Arriving(spark), sf_dir), views.track(_Arriving(spark), sf_dir), seconds, longest=3_600))
    return media_pairs(blocks, seconds, longest=3_600)


def run_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_arriving(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrived"))
    return run_once(stream_dedupe(files)).agg(F.count("*").alias("files"))
