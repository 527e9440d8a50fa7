"""Per-case aggregates of telemetry, events and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.functions.geo import seconds_between
from flightlens.operators.anomalies import neighbours
from flightlens.operators.places import with_place

WINDOW_ROWS, WINDOW_STEP = 60, 45
MAX_ROWS = 3000


def flight_summary(telemetry: DataFrame, events: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """One row per case: duration, distance, extremes, first and last times, ARM and DISARM times, counts.

    Duration runs from the first to the last row in list order and is never negative; a
    missing time makes it one second per row. With `cases`, cases without telemetry have a
    row too. ARM and DISARM fall back on the first and last row.
    """
    place = F.struct("ingest_seq", "seq")
    flown = neighbours(telemetry).groupBy("case_id").agg(
        F.min_by("ts", place).alias("start_ts"),
        F.max_by("ts", place).alias("end_ts"),
        F.round(F.coalesce(F.sum("step_m"), F.lit(0.0)), 2).alias("total_distance_m"),
        F.round(F.max("altitude_m"), 2).alias("max_altitude_m"),
        F.round(F.max("ground_speed_mps"), 2).alias("max_speed_mps"),
        F.count("*").alias("telemetry_count"),
    )
    duration = F.coalesce(F.greatest(F.lit(0.0), seconds_between(F.col("end_ts"), F.col("start_ts"))), F.col("telemetry_count").cast("double"))
    found = cases.select("case_id").distinct().join(flown, "case_id", "left") if cases is not None else flown
    if events is not None:
        done = events.groupBy("case_id").agg(
            F.min_by(F.when(F.col("event_type") == "ARM", F.col("ts")), F.when(F.col("event_type") == "ARM", place)).alias("arm"),
            F.max_by(F.when(F.col("event_type") == "DISARM", F.col("ts")), F.when(F.col("event_type") == "DISARM", place)).alias("disarm"),
            F.count("*").alias("n_events"),
        )
        found = found.join(done, "case_id", "left")
    else:
        found = found.withColumns({"arm": F.lit(None).cast("timestamp"), "disarm": F.lit(None).cast("timestamp"), "n_events": F.lit(0)})
    return found.select(
        "case_id",
        F.round(F.coalesce(duration, F.lit(0.0)), 2).alias("duration_sec"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total_distance_m", "max_altitude_m", "max_speed_mps")],
        "start_ts",
        "end_ts",
        F.coalesce("arm", "start_ts").alias("arm_ts"),
        F.coalesce("disarm", "end_ts").alias("disarm_ts"),
        F.coalesce("telemetry_count", F.lit(0)).cast("long").alias("telemetry_count"),
        F.coalesce("n_events", F.lit(0)).cast("long").alias("events_count"),
    )


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Files per case and category, and in total."""
    n = {"logs": "LOGS", "video_images": "VIDEO_IMAGES", "gcs": "GCS"}
    return evidence.groupBy("case_id").agg(*[F.count_if(F.col("category") == v).alias(k) for k, v in n.items()], F.count("*").alias("total"))


def sync_status(cases: DataFrame, **tables: DataFrame) -> DataFrame:
    """Row counts of each named table per case."""
    counted = [t.groupBy("case_id").agg(F.count("*").alias(f"{name}_count")) for name, t in tables.items()]
    joined = reduce(lambda a, b: a.join(b, "case_id", "left"), counted, cases.select("case_id").distinct())
    return joined.select("case_id", *[F.coalesce(f"{name}_count", F.lit(0)).alias(f"{name}_count") for name in tables])


def telemetry_windows(telemetry: DataFrame, rows: int = WINDOW_ROWS, step: int = WINDOW_STEP, ends: bool = False) -> DataFrame:
    """Overlapping windows of `rows` rows every `step` rows of a case; the last is the first to reach the end.

    Each row goes to the at most ceil(rows / step) windows that hold it, so windows are a
    plain grouped aggregate. ends adds the places of the first and last row (start_latitude to
    end_altitude_m) and the first one's source_channel, where telemetry has it.
    """
    placed = with_place(telemetry).withColumnsRenamed({"place": "i", "case_rows": "n"})
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - rows + 1) / step))
    last = F.floor(F.col("i") / step)
    held = placed.withColumn("win", F.explode(F.sequence(first.cast("int"), last.cast("int")))).filter((F.col("win") == 0) | (step * (F.col("win") - 1) + rows < F.col("n")))
    place = F.col("i")
    at = F.struct("latitude", "longitude", "altitude_m")
    extra = [f(at, place).alias(side) for side, f in (("_start", F.min_by), ("_end", F.max_by))] if ends else []
    if ends and "source_channel" in telemetry.columns:
        extra.append(F.min_by("source_channel", place).alias("source_channel"))
    found = held.groupBy("case_id", "win").agg(
        F.min_by("ts", place).alias("start_ts"),
        F.max_by("ts", place).alias("end_ts"),
        F.min("altitude_m").alias("min_altitude_m"),
        F.max("altitude_m").alias("max_altitude_m"),
        F.round(F.avg("ground_speed_mps"), 4).alias("avg_speed_mps"),
        F.max("ground_speed_mps").alias("max_speed_mps"),
        F.min("battery_pct").alias("min_battery_pct"),
        F.max("battery_pct").alias("max_battery_pct"),
        F.count("*").alias("samples"),
        *extra,
    )
    if not ends:
        return found
    return found.select("*", *[F.col(f"_{side}.{c}").alias(f"{side}_{c}") for side in ("start", "end") for c in ("latitude", "longitude", "altitude_m")]).drop("_start", "_end")


def endpoints(telemetry: DataFrame) -> DataFrame:
    """First and last row of each case in list order, as structs."""
    row = F.struct("ts", "latitude", "longitude", "altitude_m")
    place = F.struct("ingest_seq", "seq")
    return telemetry.groupBy("case_id").agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))


def downsample(telemetry: DataFrame, most: int = MAX_ROWS, aim: int = 1000) -> DataFrame:
    """Of cases of more than `most` rows every (n div aim)-th row; smaller cases stay whole."""
    placed = with_place(telemetry)
    return placed.filter((F.col("case_rows") <= most) | (F.col("place") % F.greatest(F.expr(f"case_rows div {aim}"), F.lit(1)) == 0)).select(*telemetry.columns)
