"""Flight lifecycle events made from the first and last row of a track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.operators.anomalies import altitude_alerts
from flightlens.operators.summary import endpoints


def synth_lifecycle(telemetry: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """ARM and TAKEOFF at the first row, LANDING at the last, DISARM a second later on the ground, an alert at the highest point above the limit.

    Event types that a case's own events already have are left out.
    """
    e = F.struct
    first, last = F.col("first"), F.col("last")

    def event(no, kind, row, ts, alt):
        return e(F.lit(no).alias("ord"), F.lit(kind).alias("event_type"), ts.alias("ts"), row["latitude"].alias("latitude"), row["longitude"].alias("longitude"), alt.alias("altitude_m"))

    made = F.array(
        event(1, "ARM", first, first["ts"], first["altitude_m"]),
        event(2, "TAKEOFF", first, first["ts"], first["altitude_m"]),
        event(4, "LANDING", last, last["ts"], last["altitude_m"]),
        event(5, "DISARM", last, last["ts"] + F.expr("interval 1 second"), F.lit(0.0)),
    )
    rows = endpoints(telemetry).select("case_id", F.explode(made).alias("m")).select("case_id", "m.*", F.lit("INFO").alias("severity"))
    alerts = altitude_alerts(telemetry).select("case_id", F.lit(3).alias("ord"), F.lit("ERROR_ALERT").alias("event_type"), "ts", "latitude", "longitude", "altitude_m", "severity")
    rows = rows.unionByName(alerts)
    if events is not None:
        rows = rows.join(events.select("case_id", "event_type").distinct(), ["case_id", "event_type"], "left_anti")
    return rows


def file_anchors(events: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Events placed at their file's first row, DISARM at its last."""
    row = F.struct("ts", "latitude", "longitude", "altitude_m")
    anchors = telemetry.groupBy("case_id", "evidence_id").agg(F.min_by(row, "seq").alias("first"), F.max_by(row, "seq").alias("last"))
    placed = events.join(anchors, ["case_id", "evidence_id"], "left").withColumn("at", F.when(F.col("event_type") == "DISARM", F.col("last")).otherwise(F.col("first")))
    return placed.select(*events.columns, F.col("at.latitude").alias("latitude"), F.col("at.longitude").alias("longitude"), F.col("at.altitude_m").alias("altitude_m"))


def boot_time(rows: DataFrame) -> DataFrame:
    """Rows of a file with absolute times: the first valid GPS time less its boot clock, plus the row's boot clock."""
    valid = F.when(F.col("gps_ts").isNotNull(), F.col("seq"))
    offset = rows.groupBy("evidence_id").agg(F.min_by(F.unix_micros("gps_ts") - F.col("boot_ms") * 1000, valid).alias("boot_epoch_us"))
    return rows.join(offset, "evidence_id", "left").withColumn("ts", F.timestamp_micros(F.col("boot_epoch_us") + F.col("boot_ms") * 1000)).drop("boot_epoch_us")
