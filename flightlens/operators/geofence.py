"""Geofence breaches: points against zones through grid cells, and episodes of breaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.functions.geo import METRES_PER_DEGREE, fixed, haversine_m, point_in_polygon
from flightlens.operators.places import by_number, in_list, numbered, with_place

CELL_DEGREES = 0.05


def _cell(degrees: Column) -> Column:
    return F.floor(degrees / F.lit(CELL_DEGREES)).cast("long")


def zone_cells(zones: DataFrame) -> DataFrame:
    """zones with one row per grid cell that their bounding box touches."""
    lats, lons = F.transform("coordinates", lambda v: v[0]), F.transform("coordinates", lambda v: v[1])
    reach_lat = F.col("radius_meters") / F.lit(METRES_PER_DEGREE)
    reach_lon = reach_lat / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("center_lat")) + reach_lat, F.lit(89.0)))), F.lit(0.01))
    circle = (F.col("zone_type") == "circle") & (F.col("radius_meters") > 0)
    polygon = (F.col("zone_type") == "polygon") & (F.size("coordinates") >= 3)
    box = {
        "lat_lo": F.when(circle, F.col("center_lat") - reach_lat).when(polygon, F.array_min(lats)),
        "lat_hi": F.when(circle, F.col("center_lat") + reach_lat).when(polygon, F.array_max(lats)),
        "lon_lo": F.when(circle, F.col("center_lon") - reach_lon).when(polygon, F.array_min(lons)),
        "lon_hi": F.when(circle, F.col("center_lon") + reach_lon).when(polygon, F.array_max(lons)),
    }
    boxed = zones.withColumns(box).filter(F.col("lat_lo").isNotNull() & F.col("lon_lo").isNotNull())
    cells = boxed.withColumn("cell_lat", F.explode(F.sequence(_cell(F.col("lat_lo")), _cell(F.col("lat_hi")))))
    return cells.withColumn("cell_lon", F.explode(F.sequence(_cell(F.col("lon_lo")), _cell(F.col("lon_hi"))))).drop(*box)


def inside_zone() -> Column:
    """The exact test of a point (latitude, longitude) against a zone row."""
    circle = haversine_m(F.col("latitude"), F.col("longitude"), F.col("center_lat"), F.col("center_lon")) <= F.col("radius_meters")
    polygon = point_in_polygon(F.col("latitude"), F.col("longitude"), F.col("coordinates"))
    return F.when(F.col("zone_type") == "circle", circle).otherwise(polygon)


def zone_active(ts: Column) -> Column:
    """Inside the zone's active window; open ends and unknown times count as inside."""
    return F.coalesce(ts >= F.col("active_from"), F.lit(True)) & F.coalesce(ts <= F.col("active_to"), F.lit(True))


def zone_matches(telemetry: DataFrame, zones: DataFrame) -> DataFrame:
    """Points with each zone they breach.

    Zones and points meet in an equi-join on the grid cell. Zone tables are small and
    Spark broadcasts them below its size threshold; above, both sides shuffle by cell.
    """
    cells = zone_cells(zones.withColumnRenamed("case_id", "zone_case_id") if "case_id" in zones.columns else zones)
    points = telemetry.withColumn("cell_lat", _cell(F.col("latitude"))).withColumn("cell_lon", _cell(F.col("longitude")))
    return points.join(cells, ["cell_lat", "cell_lon"]).filter(inside_zone() & zone_active(F.col("ts"))).drop("cell_lat", "cell_lon")


def geofence_violations(telemetry: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per point and breached zone, numbered per case in point and zone order.

    Above the zone's ceiling the breach is CEILING_EXCEEDED, else BOUNDARY_ENTRY. Points
    without a position breach nothing.
    """
    over = F.coalesce(F.col("altitude_m") > F.col("max_altitude_m"), F.lit(False))
    prefix = F.when(F.coalesce("authority", F.lit("")) != "", F.concat(F.lit(" ["), "authority", F.lit("]"))).otherwise("")
    altitude = fixed(F.col("altitude_m"), 1)
    ceiling = F.concat(F.lit("UAV exceeded statutory ceiling ("), F.col("max_altitude_m").cast("string"), F.lit("m) inside '"), "name", F.lit("'"), prefix, F.lit(" at altitude "), altitude, F.lit("m"))
    entry = F.concat(F.lit("UAV entered restricted airspace '"), "name", F.lit("'"), prefix, F.lit(" at altitude "), altitude, F.lit("m"))
    found = numbered(zone_matches(telemetry, zones), "number", ["case_id"], in_list(), ["seq", "zone_pos"])
    return found.select(
        "case_id",
        F.format_string("VIO-%04d", "number").alias("violation_id"),
        "ingest_seq",
        "seq",
        "zone_pos",
        "zone_id",
        F.col("name").alias("zone_name"),
        "ts",
        "latitude",
        "longitude",
        "altitude_m",
        F.when(over, "CEILING_EXCEEDED").otherwise("BOUNDARY_ENTRY").alias("violation_type"),
        F.when(F.col("is_preconfigured_nofly") | (F.col("zone_class") == "RED"), "CRITICAL").otherwise("WARNING").alias("severity"),
        F.when(over, ceiling).otherwise(entry).alias("details"),
        "category",
        "authority",
    )


def breach_episodes(telemetry: DataFrame, zones: DataFrame) -> DataFrame:
    """Visits to a zone: runs of consecutive points of a case inside it, with entry, exit, peak and duration."""
    placed = with_place(telemetry).withColumn("place", F.col("place") + 1).drop("case_rows")
    inside = numbered(zone_matches(placed, zones), "nth", ["case_id", "zone_id"], {"_stretch": by_number(F.col("place"))}, ["place"])
    runs = inside.withColumn("run", F.col("place") - F.col("nth"))
    return runs.groupBy("case_id", "zone_id", "run").agg(
        F.min("place").alias("first_place"),
        F.min_by("ts", "place").alias("entry_ts"),
        F.max_by("ts", "place").alias("exit_ts"),
        F.max("altitude_m").alias("max_altitude_m"),
        F.count("*").alias("points"),
    ).select(
        "case_id", "zone_id", "first_place", "entry_ts", "exit_ts", "max_altitude_m", "points",
        F.round((F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 1e6, 2).alias("duration_sec"),
    )
