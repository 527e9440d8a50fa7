"""Planned missions against flown tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlens.functions.geo import EARTH_RADIUS_M, haversine_m, off_null_island
from flightlens.session import forget, stored

ACCEPTANCE_M = 25.0
#: Degrees of the finest cells, cells of one level along a side of the next, and levels above the finest.
CELL_DEGREES, FAN, LEVELS = 0.001, 4, 9
#: Distances are rounded by less than this, as a share and in metres.
SLACK = 1e-6


def valid_waypoints(waypoints: DataFrame) -> DataFrame:
    """Waypoints with a position that are neither home nor return; of plans without any, all."""
    good = off_null_island(F.col("latitude"), F.col("longitude"), 0.001) & ~F.col("command").isin("HOME", "RETURN_TO_LAUNCH")
    plan = Window.partitionBy("case_id", "plan_id")
    return waypoints.withColumn("_good", good).withColumn("_any", F.count_if("_good").over(plan)).filter(F.col("_good") | (F.col("_any") == 0)).drop("_good", "_any")


def _cell(value: Column, level: int | Column) -> Column:
    """The cell of a coordinate; cells of a level are FAN times as wide as those of the one below."""
    return F.floor(value / (F.lit(CELL_DEGREES) * F.pow(F.lit(float(FAN)), F.lit(level) if isinstance(level, int) else level))).cast("long")


def pyramid(points: DataFrame) -> DataFrame:
    """(case_id, level, cy, cx, south, north, west, east, at): the cells of every level that hold points, their bounds, and one of the points.

    One aggregate of the finest cells, and one of all levels over those.
    """
    at = F.struct("latitude", "longitude")
    finest = points.groupBy("case_id", _cell(F.col("latitude"), 0).alias("cy"), _cell(F.col("longitude"), 0).alias("cx")).agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.min(at).alias("at")
    )
    every = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    up = F.pow(F.lit(float(FAN)), F.col("level"))
    return every.groupBy("case_id", "level", F.floor(F.col("cy") / up).cast("long").alias("cy"), F.floor(F.col("cx") / up).cast("long").alias("cx")).agg(
        F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"), F.min("at").alias("at")
    )


def _least_distance(lat: Column, lon: Column) -> Column:
    """No point within the bounds is nearer than this: the parts of the haversine formula, each at its least."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    up = F.greatest(F.lit(0.0), F.col("south") - lat, lat - F.col("north"))
    near, far = F.greatest(F.lit(0.0), F.col("west") - lon, lon - F.col("east")), F.greatest(F.abs(F.col("west") - lon), F.abs(F.col("east") - lon))
    along = F.when(far <= 180, half(near)).otherwise(F.least(half(near), half(far)))
    narrow = F.greatest(F.lit(0.0), F.least(F.cos(F.radians("south")), F.cos(F.radians("north")))) * F.greatest(F.lit(0.0), F.cos(F.radians(lat)))
    h = half(up) + narrow * F.when(far <= 360, along).otherwise(0.0)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (1 - SLACK)


def near_cells(waypoints: DataFrame, cells: DataFrame) -> DataFrame:
    """(case_id, plan_id, idx, latitude, longitude, cy, cx): the finest cells that may hold a waypoint's nearest point.

    From the widest cells down, a cell is kept while no point in it must be further than one of
    the points known: those cells' bounds and points tell. Each level meets only the cells below
    the ones kept.
    """
    key = ["case_id", "plan_id", "idx"]
    lat, lon = F.col("latitude"), F.col("longitude")
    kept = waypoints.select(*key, "latitude", "longitude", F.lit(None).cast("long").alias("py"), F.lit(None).cast("long").alias("px"))
    for level in range(LEVELS, -1, -1):
        below = cells.filter(F.col("level") == level).drop("level")
        if level == LEVELS:
            met = kept.drop("py", "px").join(below, "case_id")
        else:
            below = below.withColumns({"py": F.floor(F.col("cy") / FAN).cast("long"), "px": F.floor(F.col("cx") / FAN).cast("long")})
            met = kept.join(below, ["case_id", "py", "px"])
        met = met.withColumns({"least": _least_distance(lat, lon), "known": haversine_m(lat, lon, F.col("at.latitude"), F.col("at.longitude"))})
        best = F.min("known").over(Window.partitionBy(*key))
        kept = met.withColumn("best", best).filter(F.col("least") <= F.col("best") + SLACK).select(*key, "latitude", "longitude", F.col("cy").alias("py"), F.col("cx").alias("px"))
    return kept.withColumnsRenamed({"py": "cy", "px": "cx"})


def mission_compare(waypoints: DataFrame, telemetry: DataFrame, radius_m: float = ACCEPTANCE_M) -> DataFrame:
    """Each valid waypoint with the distance to the nearest point of its case, and whether it was reached.

    Points are kept in a pyramid of cells; a waypoint goes down it to the few finest cells that may
    hold its nearest point (near_cells) and meets the points in these alone, in an equi-join on
    the cell; the nearest is found by partial minima. Waypoints without a position, and cases
    without telemetry, have a null distance.
    """
    plan = valid_waypoints(waypoints)
    points = telemetry.select("case_id", "latitude", "longitude").filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    asked = plan.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("case_id", "plan_id", "idx", "latitude", "longitude")
    cells = stored(pyramid(points))
    wanted = stored(near_cells(asked, cells))
    placed = points.select("case_id", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"), _cell(F.col("latitude"), 0).alias("cy"), _cell(F.col("longitude"), 0).alias("cx"))
    distance = haversine_m(F.col("latitude"), F.col("longitude"), F.col("p_lat"), F.col("p_lon"))
    nearest = wanted.join(placed, ["case_id", "cy", "cx"]).groupBy("case_id", "plan_id", "idx").agg(F.min(distance).alias("distance_m"))
    nearest = stored(nearest)
    forget(cells, wanted)
    return plan.join(nearest, ["case_id", "plan_id", "idx"], "left").select(
        "case_id", "plan_id", "idx", "command", "latitude", "longitude", "altitude_m",
        F.round("distance_m", 2).alias("closest_distance_m"), F.coalesce(F.col("distance_m") <= radius_m, F.lit(False)).alias("reached"), "distance_m",
    )


def mission_compliance(compared: DataFrame) -> DataFrame:
    """Per plan: waypoints reached and missed, score, deviations, and whether it was broken off."""
    total, hit = F.count("*"), F.count_if("reached")
    return compared.groupBy("case_id", "plan_id").agg(
        F.round(hit / total * 100.0, 1).alias("compliance_pct"),
        total.alias("waypoints_total"),
        hit.alias("waypoints_reached"),
        (total - hit).alias("waypoints_missed"),
        F.round(F.coalesce(F.avg("distance_m"), F.lit(0.0)), 2).alias("mean_deviation_m"),
        F.round(F.coalesce(F.max("distance_m"), F.lit(0.0)), 2).alias("max_deviation_m"),
        ((hit > 0) & (hit < total) & ~F.max_by("reached", "idx")).alias("interrupted"),
    )


def plan_metrics(waypoints: DataFrame) -> DataFrame:
    """Per plan: waypoints with a position, length of the legs between them, highest altitude."""
    order = Window.partitionBy("case_id", "plan_id").orderBy("idx")
    legs = waypoints.filter(off_null_island(F.col("latitude"), F.col("longitude"), 0.001)).withColumn(
        "leg", haversine_m(F.lag("latitude").over(order), F.lag("longitude").over(order), F.col("latitude"), F.col("longitude"))
    )
    return legs.groupBy("case_id", "plan_id").agg(
        F.count("*").alias("waypoints"), F.round(F.coalesce(F.sum("leg"), F.lit(0.0)), 2).alias("planned_distance_m"), F.max("altitude_m").alias("planned_max_altitude_m")
    )


def waypoint_telemetry(waypoints: DataFrame, base_ts: str, seconds: int = 15) -> DataFrame:
    """Telemetry-like rows of a plan: a waypoint every `seconds` from base_ts on."""
    at = F.timestamp_micros(F.unix_micros(F.lit(base_ts).cast("timestamp")) + F.col("idx").cast("long") * F.lit(seconds * 1_000_000))
    return waypoints.select("case_id", "plan_id", F.col("idx").cast("long").alias("seq"), at.alias("ts"), "latitude", "longitude", "altitude_m", F.lit("PLANNED").alias("source_channel"))


def overview(plans: DataFrame) -> DataFrame:
    """Per case: different plans and commands."""
    return plans.groupBy("case_id").agg(F.count_distinct("plan_id").alias("plans"), F.array_sort(F.collect_set("command")).alias("commands"))
