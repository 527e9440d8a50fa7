"""The master timeline of events, breaches and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("case_id", "ts", "category", "event_type", "severity", "description", "latitude", "longitude", "altitude_m", "priority", "branch", "place")


def lifecycle_priority(event_type: Column) -> Column:
    """Order of events at the same time: from power-on through landing to disarm."""
    name = F.upper(event_type)
    return (
        F.when(name.contains("POWER_ON"), -20)
        .when(name.contains("GPS_LOCK"), -15)
        .when((name == "ARM") | name.contains("ARMED"), -10)
        .when(name.contains("TAKEOFF"), -5)
        .when(name.contains("LAND"), 10)
        .when(name.contains("DISARM"), 20)
        .otherwise(0)
    )


def master_timeline(events: DataFrame, violations: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """All incidents of all cases; anomalies without a time stay out and have no position."""
    position = [F.col(c) for c in ("latitude", "longitude", "altitude_m")]
    nowhere = [F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude", "altitude_m")]
    parts = [events.select("case_id", "ts", F.lit("FLIGHT_EVENT").alias("category"), "event_type", "severity", "description", *position, F.lit(0).alias("branch"), F.struct("ingest_seq", "seq", F.lit(0).alias("z")).alias("place"))]
    if violations is not None:
        text = F.concat(F.lit("Zone Violation ["), "zone_name", F.lit("]: "), "details")
        parts.append(violations.select("case_id", "ts", F.lit("GEOFENCE_BREACH").alias("category"), F.col("violation_type").alias("event_type"), "severity", text.alias("description"), *position, F.lit(1).alias("branch"), F.struct("ingest_seq", "seq", F.col("zone_pos").alias("z")).alias("place")))
    if anomalies is not None:
        text = F.concat(F.lit("Integrity Anomaly: "), "description")
        parts.append(anomalies.filter(F.col("ts").isNotNull()).select("case_id", "ts", F.lit("ANOMALY").alias("category"), F.col("anomaly_type").alias("event_type"), "severity", text.alias("description"), *nowhere, F.lit(2).alias("branch"), F.struct("ingest_seq", "seq", F.lit(0).alias("z")).alias("place")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumn("priority", lifecycle_priority(F.col("event_type"))).select(*COLUMNS)


def ordered_timeline(timeline: DataFrame) -> DataFrame:
    """By time, then lifecycle, then source and its own order."""
    return timeline.orderBy("case_id", F.col("ts").asc_nulls_first(), "priority", "branch", "place")
