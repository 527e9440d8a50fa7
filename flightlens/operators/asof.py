"""Joins to the nearest or last row in time, without range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.operators.places import by_number, by_time, in_list, numbered, with_last, with_previous, with_running

CONFIDENT_SECONDS = 2.0
IMAGE_TOLERANCE, VIDEO_PADDING = 60.0, 15.0


def nearest_media(media: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Each media row with the telemetry row of its case nearest in time; equally near: the earlier in the list.

    Both tables are sorted together in stretches of time; running windows carry the last
    telemetry row before and the first after each media row, from stretch to stretch by one
    row each, so no row meets more than two candidates and no task has a whole case. Media
    without a time, or whose case has no telemetry, have no row.
    """
    nothing = F.lit(None).cast("struct<ts:timestamp,ingest_seq:bigint,seq:bigint,latitude:double,longitude:double,altitude_m:double>")
    left = media.filter(F.col("ts").isNotNull()).select("case_id", "ts", F.col("media_id"), F.lit(1).alias("kind"), nothing.alias("p"))
    # Of points at the same time the first in the list stands for all.
    firsts = telemetry.filter(F.col("ts").isNotNull()).groupBy("case_id", "ts").agg(F.min_by(F.struct(F.col("ingest_seq").cast("long").alias("ingest_seq"), F.col("seq").cast("long").alias("seq"), "latitude", "longitude", "altitude_m"), F.struct("ingest_seq", "seq")).alias("q"))
    right = firsts.select("case_id", "ts", F.lit(None).cast("long").alias("media_id"), F.lit(0).alias("kind"), F.struct("ts", "q.*").alias("p"))
    stretch = {"_stretch": by_time(F.col("ts"))}
    both = with_last(left.unionByName(right), {"before": F.col("p")}, ["case_id"], stretch, ["ts", "kind"])
    both = with_last(both, {"after": F.col("p")}, ["case_id"], stretch, ["ts", "kind"], descending=True)
    gap = lambda p: F.abs(F.unix_micros(F.col("ts")) - F.unix_micros(F.col(f"{p}.ts"))) / F.lit(1e6)
    earlier = (gap("before") < gap("after")) | ((gap("before") == gap("after")) & (F.struct("before.ingest_seq", "before.seq") < F.struct("after.ingest_seq", "after.seq")))
    chosen = both.filter("kind = 1").withColumn("m", F.when(F.col("after").isNull() | (F.col("before").isNotNull() & earlier), F.col("before")).otherwise(F.col("after"))).filter(F.col("m").isNotNull())
    delta = gap("m")
    return chosen.select(
        "case_id", "media_id", F.col("ts").alias("capture_ts"), F.col("m.ts").alias("matched_ts"), F.col("m.seq").alias("matched_seq"), F.round(delta, 2).alias("delta_seconds"),
        F.col("m.latitude").alias("latitude"), F.col("m.longitude").alias("longitude"), F.col("m.altitude_m").alias("altitude_m"), (delta <= CONFIDENT_SECONDS).alias("high_confidence"),
    )


def media_overlap(media: DataFrame, telemetry: DataFrame, tolerance: float = IMAGE_TOLERANCE, padding: float = VIDEO_PADDING) -> DataFrame:
    """Whether each media row falls into its case's flight, with the matched point if so.

    A video overlaps when its padded interval meets the flight's, or its start is no
    further from a point than its padded length; an image within `tolerance` of a point.
    """
    window = telemetry.groupBy("case_id").agg(F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))
    near = nearest_media(media, telemetry).select("case_id", "media_id", "matched_ts", "matched_seq", "latitude", "longitude", "altitude_m", (F.abs(F.unix_micros("capture_ts") - F.unix_micros("matched_ts")) / F.lit(1e6)).alias("delta"))
    rows = media.select("case_id", "media_id", "ts", "duration_sec").join(window, "case_id", "left").join(near, ["case_id", "media_id"], "left")
    start, length = F.unix_micros("ts") / F.lit(1e6), F.coalesce("duration_sec", F.lit(0.0))
    meets = F.greatest(start - padding, F.unix_micros("window_start") / F.lit(1e6)) <= F.least(start + length + padding, F.unix_micros("window_end") / F.lit(1e6))
    overlap = F.coalesce(F.when(length > 0, meets | (F.col("delta") <= length + padding)).otherwise(F.col("delta") <= tolerance), F.lit(False))
    return rows.withColumn("has_overlap", overlap).select(
        "case_id", "media_id", "ts", "duration_sec", "has_overlap",
        *[F.when(F.col("has_overlap"), F.col(c)).alias(c) for c in ("matched_ts", "matched_seq", "latitude", "longitude", "altitude_m")],
        F.when(F.col("has_overlap"), F.round("delta", 2)).alias("delta_seconds"),
        "window_start", "window_end",
    )


def media_events(overlap: DataFrame) -> DataFrame:
    """A MEDIA_CAPTURE event for each media row that falls into a flight."""
    return overlap.filter("has_overlap").select(
        "case_id", "media_id", "ts", F.lit("MEDIA_CAPTURE").alias("event_type"), F.lit("INFO").alias("severity"), "latitude", "longitude", "altitude_m", "delta_seconds"
    )


def media_capture(media: DataFrame, overlap: DataFrame) -> DataFrame:
    """media with the matched position, or its own geotag where nothing matched."""
    matched = overlap.select("case_id", "media_id", "has_overlap", *[F.col(c).alias(f"m_{c}") for c in ("latitude", "longitude", "altitude_m")])
    own = [F.coalesce(f"m_{c}", f"tag_{c}").alias(c) for c in ("latitude", "longitude", "altitude_m")]
    return media.join(matched, ["case_id", "media_id"], "left").select("case_id", "media_id", "ts", "has_overlap", *own)


def carry_forward(rows: DataFrame, columns: list[str], partition: list[str] | None = None) -> DataFrame:
    """Nulls of the columns filled with the last value before them in list order."""
    found = with_last(rows, {c: F.col(c) for c in columns}, partition or ["case_id"], in_list(), ["seq"])
    return found.select(*rows.columns)


def last_known_position(events: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Events with the position of the last telemetry row not after them."""
    position = ("latitude", "longitude", "altitude_m")
    left = events.select("case_id", "ts", "event_id", "event_type", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ord"), *[F.lit(None).cast("double").alias(c) for c in position])
    right = telemetry.select("case_id", "ts", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("ord"), *position)
    found = with_last(left.unionByName(right), {c: F.col(c) for c in position}, ["case_id"], {"_stretch": by_time(F.col("ts"))}, ["ts", "kind", "ord"])
    return found.filter("kind = 1").select("case_id", "event_id", "event_type", "ts", *position)


def arm_edges(rows: DataFrame, armed: Column) -> DataFrame:
    """Rows at which the armed state changes; before the first row it is off."""
    marked = with_previous(rows.withColumn("armed", F.coalesce(armed, F.lit(False))), ("armed",))
    changed = marked.filter(F.col("armed") != F.coalesce("prev_armed", F.lit(False)))
    return changed.withColumn("event_type", F.when(F.col("armed"), "ARM").otherwise("DISARM")).drop("prev_armed", "armed")


def resample(telemetry: DataFrame, step_ms: int = 1000) -> DataFrame:
    """One row per case and slot of `step_ms` that holds rows, stamped with the slot's start, with the last known values.

    Slots count from the case's first time. A value is the last one that is not null in the
    slot, or, if it has none, in the slots before. Where a file emits at most once per
    message and slot, these are its emissions; empty slots give no row.
    """
    values = ("latitude", "longitude", "altitude_m")
    timed = telemetry.filter(F.col("ts").isNotNull())
    starts = timed.groupBy("case_id").agg(F.min(F.unix_micros("ts")).alias("t0")).withColumnRenamed("case_id", "_case")
    slots = timed.join(starts, F.col("case_id").eqNullSafe(F.col("_case"))).withColumn("slot", F.floor((F.unix_micros("ts") - F.col("t0")) / F.lit(step_ms * 1000)).cast("long"))
    order = F.struct("ts", "ingest_seq", "seq")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    found = slots.groupBy("case_id", "slot").agg(F.min("t0").alias("t0"), *last, F.count("*").alias("rows_in_slot"))
    found = with_last(found, {c: F.col(c) for c in values}, ["case_id"], {"_stretch": by_number(F.col("slot"))}, ["slot"])
    return found.select("case_id", "slot", F.timestamp_micros(F.col("t0") + F.col("slot") * (step_ms * 1000)).alias("slot_ts"), *values, "rows_in_slot")


def emissions(messages: DataFrame, step_ms: int = 1000) -> DataFrame:
    """The rows at which a sampler of `step_ms` emits, with the last values known there; messages with a time, in time order.

    The sampler emits at most once a message, when the message's time has come to its clock, and
    each emission moves the clock on by one step from the case's first time; so behind a gap the
    messages catch up, one step each. After message i it has emitted e(i) = min(e(i-1) + 1,
    slot(i) + 1) times, where slot is the number of whole steps since the first time: that is i
    plus the least slot(j) + 1 - j up to i, a running minimum, carried over stretches of time.

    Returns case_id, number (from 1), clock_ms (since the first time), ts, and latitude, longitude,
    altitude_m, roll_deg, pitch_deg and yaw_deg, each the last that is not null.
    """
    values = ("latitude", "longitude", "altitude_m", "roll_deg", "pitch_deg", "yaw_deg")
    stretch, order = {"_stretch": by_time(F.col("ts"))}, ["ts", "ingest_seq", "seq"]
    rows = messages.filter(F.col("ts").isNotNull()).select("case_id", *order, *values)
    starts = rows.groupBy("case_id").agg(F.min(F.unix_micros("ts")).alias("t0")).withColumnRenamed("case_id", "_case")
    timed = rows.join(starts, F.col("case_id").eqNullSafe(F.col("_case"))).drop("_case")
    timed = timed.withColumn("slot", F.floor((F.unix_micros("ts") - F.col("t0")) / F.lit(step_ms * 1000)).cast("long")).drop("t0")
    placed = numbered(timed, "i", ["case_id"], stretch, order).withColumn("i", F.col("i") - 1)
    bounded = with_running(placed, "least", F.col("slot") + 1 - F.col("i"), ["case_id"], stretch, order)
    known = with_last(bounded, {c: F.col(c) for c in values}, ["case_id"], stretch, order)
    before = F.coalesce(F.col("i") - 1 + F.col("least"), F.lit(0))  # emitted before this message
    found = known.withColumn("number", before + 1).filter(F.col("slot") >= F.col("number") - 1)
    return found.select("case_id", F.col("number").cast("long").alias("number"), ((F.col("number") - 1) * step_ms).cast("long").alias("clock_ms"), "ts", *values)
