"""Anomalies between neighbouring telemetry rows, and events that contradict the flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.functions.geo import fixed, haversine_m, is_valid_fix, seconds_between
from flightlens.operators.places import in_list, numbered, with_previous

GAP_SECONDS = 5.0
JUMP_MPS = 60.0
AIRBORNE_M = 5.0
ALTITUDE_LIMIT_M = 120.0


def neighbours(telemetry: DataFrame, per_file: bool = False) -> DataFrame:
    """Rows with the row before them in list order (not time order): prev_ts, gap_sec, step_m.

    per_file keeps the end of one file from meeting the start of the next. The windows run
    over stretches of a case, so a case of any size is dealt over many tasks.
    """
    lagged = with_previous(telemetry, ("ts", "latitude", "longitude"), per_file)
    return lagged.select(
        "*",
        seconds_between(F.col("ts"), F.col("prev_ts")).alias("gap_sec"),
        haversine_m(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude")).alias("step_m"),
    )


def _report(rows: DataFrame, check: int, kind: str, severity: str, description, ts: str) -> DataFrame:
    return rows.select(
        "case_id", "ingest_seq", "seq", F.lit(check).alias("check_no"), F.lit(kind).alias("anomaly_type"), F.lit(severity).alias("severity"), description.alias("description"), F.col(ts).alias("ts")
    )


def anomaly_candidates(telemetry: DataFrame, events: DataFrame | None = None, gap_seconds: float = GAP_SECONDS, jump_mps: float = JUMP_MPS, per_file: bool = False) -> DataFrame:
    """Clock reversals, gaps, jumps and mid-air disarms, without their numbers."""
    rows = neighbours(telemetry, per_file)
    speed = F.col("step_m") / F.when(F.col("gap_sec") > 0, F.col("gap_sec"))
    # One pass over the rows: each yields up to two findings.
    found = F.array(
        F.when(
            F.col("gap_sec") < 0,
            F.struct(F.lit(1).alias("check_no"), F.lit("CLOCK_SKEW").alias("anomaly_type"), F.lit("HIGH").alias("severity"), F.concat(F.lit("Time reversal detected: sequence time dropped by "), fixed(F.abs("gap_sec"), 2), F.lit("s")).alias("description"), F.col("ts").alias("at")),
        ).when(
            F.col("gap_sec") > gap_seconds,
            F.struct(F.lit(1).alias("check_no"), F.lit("TIMESTAMP_GAP").alias("anomaly_type"), F.lit("MEDIUM").alias("severity"), F.concat(F.lit("Significant telemetry interruption: "), fixed(F.col("gap_sec"), 1), F.lit("s missing between records")).alias("description"), F.col("prev_ts").alias("at")),
        ),
        F.when(
            speed > jump_mps,
            F.struct(F.lit(2).alias("check_no"), F.lit("GPS_DISCORDANCE").alias("anomaly_type"), F.lit("HIGH").alias("severity"), F.concat(F.lit("Kinematic anomaly / coordinate jump: calculated velocity "), fixed(speed, 1), F.lit(" m/s exceeds physical aerodynamic threshold")).alias("description"), F.col("ts").alias("at")),
        ),
    )
    between = rows.select("case_id", "ingest_seq", "seq", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select(
        "case_id", "ingest_seq", "seq", "a.check_no", "a.anomaly_type", "a.severity", "a.description", F.col("a.at").alias("ts")
    )
    return between if events is None else between.unionByName(midair_disarms(events))


def midair_disarms(events: DataFrame, airborne_m: float = AIRBORNE_M) -> DataFrame:
    """DISARM events above the ground; they come behind all others in a report."""
    rows = events.filter((F.col("event_type") == "DISARM") & (F.col("altitude_m") > airborne_m))
    text = F.concat(F.lit("Catastrophic event: Disarm command triggered while UAV was airborne at altitude "), fixed(F.col("altitude_m"), 1), F.lit("m"))
    return _report(rows, 3, "UNEXPECTED_DISARM", "CRITICAL", text, "ts")


def anomaly_report(telemetry: DataFrame, events: DataFrame | None = None, **limits) -> DataFrame:
    """The findings, numbered per case: by point, then check; events last."""
    stretch = {"_late": F.col("check_no") == 3, **in_list()}
    found = numbered(anomaly_candidates(telemetry, events, **limits), "number", ["case_id"], stretch, ["seq", "check_no"])
    return found.select("case_id", F.format_string("ANOM-%03d", "number").alias("anomaly_id"), "ingest_seq", "seq", "anomaly_type", "severity", "description", "ts")


def altitude_alerts(telemetry: DataFrame, limit_m: float = ALTITUDE_LIMIT_M) -> DataFrame:
    """The first highest point of each case that rose above the limit."""
    top = telemetry.groupBy("case_id").agg(
        F.max("altitude_m").alias("altitude_m"), F.max_by(F.struct("ts", "seq", "latitude", "longitude"), F.struct("altitude_m", -F.col("ingest_seq"), -F.col("seq"))).alias("p")
    )
    return top.filter(F.col("altitude_m") > limit_m).select("case_id", "altitude_m", "p.*", F.lit("WARNING").alias("severity"))


def validity(telemetry: DataFrame) -> DataFrame:
    """Per case: rows, rows with a valid fix, and whether time never runs backwards."""
    rows = neighbours(telemetry)
    return rows.groupBy("case_id").agg(
        F.count("*").alias("points"),
        F.count_if(is_valid_fix(F.col("latitude"), F.col("longitude"), F.col("altitude_m"))).alias("valid_points"),
        F.bool_and(F.coalesce(F.col("gap_sec") >= 0, F.lit(True))).alias("chronological"),
    )
