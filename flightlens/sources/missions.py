"""Mission plans and companion-app files as waypoint, zone, telemetry and operator rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.functions.geo import feet_to_metres, off_null_island
from flightlens.sources.flight_logs import _LOG, _telemetry
from flightlens.sources.lines import at, fields, named_column, number, numbered, parse_ts, read_lines, read_table, read_whole

#: Names of the mission commands that plans hold.
COMMANDS = {
    16: "WAYPOINT", 17: "LOITER_UNLIM", 18: "LOITER_TURNS", 19: "LOITER_TIME", 20: "RETURN_TO_LAUNCH", 21: "LAND", 22: "TAKEOFF", 82: "SPLINE_WAYPOINT",
    84: "VTOL_TAKEOFF", 85: "VTOL_LAND", 177: "DO_SET_ROI", 178: "DO_DIGICAM_CONTROL", 201: "DO_SET_ROI_LOCATION", 206: "DO_SET_SERVO",
}
WAYPOINT = ("file", "idx", "command", "latitude", "longitude", "altitude_m", "speed_mps")


def command_name(code: Column) -> Column:
    """The command's name, MAV_CMD_n for others."""
    names = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])
    return F.coalesce(F.element_at(names, code.cast("int")), F.concat(F.lit("MAV_CMD_"), code.cast("int").cast("string")))


def _waypoints(rows: DataFrame, **columns: Column) -> DataFrame:
    made = rows.withColumns(columns)
    for name in ("latitude", "longitude"):
        made = made.withColumn(name, F.round(name, 7))
    return made.withColumn("altitude_m", F.round("altitude_m", 2)).select(*WAYPOINT)


def home_locations(waypoints: DataFrame, source: str) -> DataFrame:
    """The position of each file's HOME waypoint as an operator location."""
    home = (F.col("command") == "HOME") & off_null_island(F.col("latitude"), F.col("longitude"), 0.001)
    return waypoints.filter(home).select("file", F.lit(source).alias("source"), "latitude", "longitude", "altitude_m")


def read_wpl(spark: SparkSession, path: str) -> DataFrame:
    """Tabular waypoint files: the first line names the format, rows have at least eleven fields; row 0 is home."""
    lines = read_lines(spark, path).filter((F.trim("line") != "") & ~F.col("line").startswith("#"))
    heads = lines.groupBy("file").agg(F.min_by("line", F.struct("block", "id")).alias("head")).filter(F.col("head").contains("QGC WPL"))
    rows = lines.join(heads, "file", "left_semi").withColumn("p", F.split(F.trim("line"), r"\s+")).filter(F.size("p") >= 11)
    value = lambda i: number(F.get("p", F.lit(i)))
    idx = F.get("p", F.lit(0)).try_cast("int")
    made = rows.withColumn("idx", idx).filter(F.col("idx").isNotNull() & value(8).isNotNull() & value(9).isNotNull() & value(3).isNotNull())
    return _waypoints(made, command=F.when(F.col("idx") == 0, "HOME").otherwise(command_name(value(3))), latitude=value(8), longitude=value(9), altitude_m=value(10), speed_mps=F.lit(12.0))


_PLAN = (
    "groundStation string, mission struct<plannedHomePosition: array<double>, cruiseSpeed: double, items: array<struct<command: int, params: array<double>, autoContinue: boolean>>>, "
    "geoFence struct<polygons: array<struct<polygon: array<array<double>>, inclusion: boolean>>>"
)


def _plan(spark: SparkSession, path: str) -> DataFrame:
    return read_whole(spark, path).select("file", F.from_json("text", _PLAN).alias("d"))


def read_qgc_plan(spark: SparkSession, path: str) -> DataFrame:
    """JSON plans: items in order, positions in the fifth to seventh parameter; the planned home is row 0."""
    plan = _plan(spark, path)
    items = plan.select("file", F.coalesce("d.mission.cruiseSpeed", F.lit(15.0)).alias("speed_mps"), F.posexplode("d.mission.items").alias("pos", "it"))
    value = lambda i: F.coalesce(F.get("it.params", F.lit(i)), F.lit(0.0))
    rows = _waypoints(items, idx=F.col("pos") + 1, command=command_name(F.coalesce("it.command", F.lit(16))), latitude=value(4), longitude=value(5), altitude_m=value(6))
    home = F.col("d.mission.plannedHomePosition")
    homes = _waypoints(
        plan.filter(F.size(home) >= 2), idx=F.lit(0), command=F.lit("HOME"), latitude=F.get(home, F.lit(0)), longitude=F.get(home, F.lit(1)), altitude_m=F.coalesce(F.get(home, F.lit(2)), F.lit(0.0)), speed_mps=F.lit(None).cast("double")
    )
    return homes.unionByName(rows)


def read_plan_fences(spark: SparkSession, path: str) -> DataFrame:
    """Fence polygons of JSON plans: exclusions are red, inclusions yellow."""
    rows = _plan(spark, path).select("file", F.posexplode("d.geoFence.polygons").alias("pos", "f")).filter(F.size("f.polygon") > 0)
    inclusion = F.coalesce("f.inclusion", F.lit(False))
    return rows.select(
        "file", F.concat(F.lit("QGC-FENCE-"), (F.col("pos") + 1).cast("string")).alias("zone_id"), F.lit("polygon").alias("zone_type"), F.col("f.polygon").alias("coordinates"),
        F.when(inclusion, "YELLOW").otherwise("RED").alias("zone_class"), F.lit("CUSTOM").alias("category"),
    )


def read_wpml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with coordinates (longitude first); an execution height overrides the altitude, 50 m and 10 m/s without."""
    marks = read_whole(spark, path).select("file", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<(?:\w+:)?Placemark\b.*?</(?:\w+:)?Placemark>"), 0)).alias("pos", "mark"))
    tag = lambda name: F.trim(F.regexp_extract("mark", rf"(?s)<(?:\w+:)?{name}\b[^>]*>(.*?)<", 1))
    p = fields(tag("coordinates"))
    rows = marks.filter(F.size(p) >= 2)
    lat, lon = number(F.get(p, F.lit(1))), number(F.get(p, F.lit(0)))
    return _waypoints(
        rows.filter(lat.isNotNull() & lon.isNotNull()), idx=F.col("pos") + 1, command=F.lit("WAYPOINT"), latitude=lat, longitude=lon,
        altitude_m=F.coalesce(number(tag("executeHeight")), number(F.get(p, F.lit(2))), F.lit(50.0)), speed_mps=F.round(F.coalesce(number(tag("waypointSpeed")), F.lit(10.0)), 2),
    )


_WP = "array<struct<latitude: double, lat: double, longitude: double, lon: double, lng: double, altitude: double, alt: double, speed: double, action: string>>"
_MISSION = f"waypoints {_WP}, points {_WP}, mission struct<waypoints: {_WP}>, home_location struct<latitude: double, lat: double, longitude: double, lon: double>, controller_location struct<latitude: double, longitude: double>"


def read_mission_json(spark: SparkSession, path: str, altitude_m: float = 30.0, speed_mps: float = 8.0) -> DataFrame:
    """JSON missions of several apps: the waypoints under any of their names, with defaults for altitude and speed."""
    d = read_whole(spark, path).select("file", F.from_json("text", _MISSION).alias("d"))
    lists = [F.when(F.size(c) > 0, F.col(c)) for c in ("d.waypoints", "d.mission.waypoints", "d.points")]
    rows = d.select("file", F.posexplode(F.coalesce(*lists)).alias("pos", "w"))
    return _waypoints(
        rows, idx=F.col("pos") + 1, command=F.upper(F.coalesce("w.action", F.lit("WAYPOINT"))), latitude=F.coalesce("w.latitude", "w.lat", F.lit(0.0)), longitude=F.coalesce("w.longitude", "w.lon", "w.lng", F.lit(0.0)),
        altitude_m=F.coalesce("w.altitude", "w.alt", F.lit(altitude_m)), speed_mps=F.coalesce("w.speed", F.lit(speed_mps)),
    )


def read_gspro(spark: SparkSession, path: str) -> DataFrame:
    return read_mission_json(spark, path, 30.0, 8.0)


def read_flightplan_json(spark: SparkSession, path: str) -> DataFrame:
    return read_mission_json(spark, path, 25.0, 10.0)


def read_litchi_mission_json(spark: SparkSession, path: str) -> DataFrame:
    return read_mission_json(spark, path, 50.0, 5.0)


def json_homes(spark: SparkSession, path: str) -> DataFrame:
    """Operator locations of JSON missions: the controller's position, else the home location."""
    d = read_whole(spark, path).select("file", F.from_json("text", _MISSION).alias("d"))
    lat, lon = F.coalesce("d.controller_location.latitude", "d.home_location.latitude", "d.home_location.lat"), F.coalesce("d.controller_location.longitude", "d.home_location.longitude", "d.home_location.lon")
    return d.filter((lat != 0) & (lon != 0)).select("file", lat.alias("latitude"), lon.alias("longitude"))


def read_inav_mission(spark: SparkSession, path: str) -> DataFrame:
    """Mission texts in commas or white space: rows of at least eleven fields are tabular waypoints, of four or more short ones."""
    lines = numbered(read_lines(spark, path).filter((F.trim("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").contains("QGC WPL")), 1, "idx")
    comma = F.col("line").contains(",")
    rows = lines.withColumn("p", F.when(comma, fields(F.col("line"))).otherwise(F.split(F.trim("line"), r"\s+"))).filter(F.size("p") >= 4)
    wide = ~comma & (F.size("p") >= 11)
    value = lambda i: number(F.get("p", F.lit(i)))
    action = F.get("p", F.lit(1))
    command = F.when(wide, command_name(value(3))).when(action.rlike(r"^[\d.]+$"), "WAYPOINT").otherwise(F.upper(action))
    lat, lon = F.when(wide, value(8)).otherwise(value(2)), F.when(wide, value(9)).otherwise(value(3))
    return _waypoints(
        rows.filter(lat.isNotNull() & lon.isNotNull()), command=command, latitude=lat, longitude=lon,
        altitude_m=F.coalesce(F.when(wide, value(10)).otherwise(value(4)), F.lit(30.0)), speed_mps=F.when(wide, F.lit(15.0)).otherwise(F.coalesce(value(5), F.lit(15.0))),
    )


def read_inav_xml(spark: SparkSession, path: str) -> DataFrame:
    """Mission items of XML files by their attributes."""
    items = read_whole(spark, path).select("file", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?i)<(?:missionitem|waypoint|wp)\b[^>]*>"), 0)).alias("pos", "item"))
    tag = lambda names: F.regexp_extract("item", rf"(?i)\b(?:{names})\s*=\s*[\"']([^\"']*)", 1)
    lat, lon = number(tag("lat|latitude")), number(tag("lon|lng|longitude"))
    action = F.upper(tag("action"))
    return _waypoints(
        items.filter(lat.isNotNull() & lon.isNotNull()), idx=F.col("pos") + 1, command=F.when(action == "", "WAYPOINT").otherwise(action), latitude=lat, longitude=lon,
        altitude_m=F.coalesce(number(tag("alt|altitude")), F.lit(30.0)), speed_mps=F.coalesce(number(tag("speed")), F.lit(15.0)),
    )


# ---------------------------------------------------------------- companion apps


def _operator(rows: DataFrame, *pairs: tuple[Column, Column, str]) -> DataFrame:
    """Per file the first valid position of the pairs: all rows of an earlier pair go before a later pair's."""
    fixes = [F.when(off_null_island(a, b, 0.01), F.struct(F.lit(i).alias("o"), a.alias("latitude"), b.alias("longitude"))) for i, (a, b, _) in enumerate(pairs)]
    found = rows.select("file", "block", "id", F.explode(F.array_compact(F.array(*fixes))).alias("f")).select("file", "block", "id", "f.*")
    firsts = found.groupBy("file", "o", "block").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in ("latitude", "longitude")])  # numbers alone: nothing is sorted
    best = firsts.groupBy("file").agg(F.min(F.struct("o", "block", "id", "latitude", "longitude")).alias("f"))
    return best.select("file", "f.latitude", "f.longitude", F.get(F.array(*[F.lit(s) for _, _, s in pairs]), F.col("f.o")).alias("source"))


def read_litchi_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(telemetry, operator locations) of phone logs: the phone's own position goes before the home point's."""
    rows, h, p = read_table(spark, path), F.col("header"), F.col("parts")
    get = lambda *names: number(at(p, named_column(h, *names)))
    lat, lon = get("latitude", "lat"), get("longitude", "lon")
    raw = at(p, named_column(h, "datetime(utc)", "datetime", "time", "timestamp"))
    track = _telemetry(
        rows.filter(off_null_island(lat, lon, 0.01)), "LITCHI_CSV", ts_raw=raw, ts=parse_ts(raw), latitude=lat, longitude=lon,
        altitude_m=F.coalesce(get("altitude(m)", "altitude"), feet_to_metres(get("altitude(feet)", "altitude(ft)")), F.lit(0.0)), ground_speed_mps=F.coalesce(get("speed(m/s)", "speed"), F.lit(0.0)), battery_pct=get("battery(%)", "remainpowerpercent", "battery"),
    )
    homes = _operator(rows, (get("phone_latitude"), get("phone_longitude"), "PHONE_GPS"), (get("home_latitude"), get("home_longitude"), "HOME_POINT"))
    return track, homes


def read_litchi_mission(spark: SparkSession, path: str) -> DataFrame:
    """Waypoint tables of the phone app; 50 m and 5 m/s without values."""
    rows, h, p = numbered(read_table(spark, path), 1, "idx"), F.col("header"), F.col("parts")
    get = lambda *names: number(at(p, named_column(h, *names)))
    lat, lon = get("latitude", "lat"), get("longitude", "lon")
    return _waypoints(
        rows.filter(lat.isNotNull() & lon.isNotNull()), command=F.lit("WAYPOINT"), latitude=lat, longitude=lon, altitude_m=F.coalesce(get("altitude(m)", "altitude"), F.lit(50.0)), speed_mps=F.coalesce(get("speed(m/s)", "speed"), F.lit(5.0))
    )


def read_mobile_flight_txt(spark: SparkSession, path: str, most: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(telemetry, operator locations, serials) of phone flight records; of each file the first `most` data lines count."""
    rows, h, p = numbered(read_table(spark, path), 1, "k").filter(F.col("k") <= most), F.col("header"), F.col("parts")
    get = lambda *names: number(at(p, named_column(h, *names)))
    lat, lon = get("latitude", "osd.latitude", "lat"), get("longitude", "osd.longitude", "lon")
    raw = at(p, named_column(h, "datetime", "timestamp", "time", "custom.updatetime"))
    track = _telemetry(rows.filter(off_null_island(lat, lon, 0.01)), "MOBILE_FLIGHT_TXT", ts_raw=raw, ts=parse_ts(raw), latitude=lat, longitude=lon, altitude_m=F.coalesce(get("altitude", "height", "osd.height"), F.lit(0.0)))
    homes = _operator(rows, (get("rc_latitude", "rc.latitude"), get("rc_longitude", "rc.longitude"), "RC_GPS"), (get("home_latitude", "home.latitude"), get("home_longitude", "home.longitude"), "HOME_POINT"))
    serials = read_lines(spark, path).select("file", F.regexp_extract("line", r"(?i)\bSN:\s*([\w-]+)", 1).alias("serial"), F.struct("block", "id").alias("o")).filter("serial <> ''").groupBy("file").agg(F.min_by("serial", "o").alias("serial"))
    return track, homes, serials


def read_freeflight_serials(spark: SparkSession, path: str) -> DataFrame:
    """(file, serial, product) of JSON flight dumps, whose points the JSON telemetry reader takes."""
    d = read_whole(spark, path).select("file", F.from_json(F.regexp_extract("text", r"(?s)(\{.*)", 1), _LOG).alias("d"))
    return d.select("file", F.coalesce("d.serial_number", "d.serial").alias("serial"), F.col("d.product_name").alias("product"))


def read_cli_config(spark: SparkSession, path: str) -> DataFrame:
    """(file, config): 'set k = v' and 'name x' lines and the firmware banner as a map; the last value wins."""
    line = F.trim("line")
    key = F.when(line.rlike(r"^set\s"), F.trim(F.regexp_extract(line, r"^set\s+([^=]+)=", 1))).when(line.rlike(r"^name\s"), F.lit("craft_name")).when(line.rlike(r"^# .*(?:Betaflight|INAV|Cleanflight)"), F.lit("firmware"))
    value = F.when(line.startswith("set"), F.trim(F.regexp_extract(line, "=(.*)$", 1))).otherwise(F.trim(F.regexp_extract(line, r"^(?:name|#)\s+(.*)$", 1)))
    rows = read_lines(spark, path).select("file", key.alias("name"), value.alias("value"), F.struct("block", "id").alias("o")).filter(F.col("name").isNotNull() & (F.col("name") != ""))
    last = rows.groupBy("file", "name").agg(F.max_by("value", "o").alias("value"))
    return last.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("config"))


def read_autel_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(telemetry, operator locations, serials) of tables of another maker's app."""
    rows, h, p = read_table(spark, path), F.col("header"), F.col("parts")
    get = lambda *names: number(at(p, named_column(h, *names)))
    lat, lon = get("latitude", "lat", "drone_lat"), get("longitude", "lon", "drone_lon")
    raw = at(p, named_column(h, "datetime", "timestamp", "time"))
    track = _telemetry(
        rows.filter(off_null_island(lat, lon, 0.01)), "AUTEL_CSV", ts_raw=raw, ts=parse_ts(raw), latitude=lat, longitude=lon, altitude_m=F.coalesce(get("altitude", "alt", "height"), F.lit(0.0)), ground_speed_mps=F.coalesce(get("speed", "velocity"), F.lit(0.0)), battery_pct=get("battery")
    )
    homes = _operator(rows, (get("pilot_lat", "pilot_latitude"), get("pilot_lon", "pilot_longitude"), "PILOT_GPS"), (get("home_lat", "home_latitude"), get("home_lon", "home_longitude"), "HOME_POINT"))
    serial = at(p, named_column(h, "sn", "serial", "serial_number", "aircraft_sn"))
    serials = rows.select("file", serial.alias("serial"), F.struct("block", "id").alias("o")).filter(F.col("serial") != "").groupBy("file").agg(F.min_by("serial", "o").alias("serial"))
    return track, homes, serials


#: Brands that a text dump of a capture may name.
DUMP_BRANDS = ("DJI", "Mavic", "Bebop", "Anafi", "ArduPilot", "PX4")


def read_text_dump(spark: SparkSession, path: str) -> DataFrame:
    """Per text dump its lines and the brands they name."""
    named = F.array_compact(F.array(*[F.when(F.col("line").contains(b), b) for b in DUMP_BRANDS]))
    return read_lines(spark, path).groupBy("file").agg(F.count("*").alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(named)))).alias("brands"))
