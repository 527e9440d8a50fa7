"""Queries of the readers: tables written as files of each format, and read again.

The rows of the given tables are rendered as lines, one file per case (or per case and day
for formats that only parse as a whole), in the shared folder; the readers then take those
files. The oracles state what the readers must give from the tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightlens.functions.geo import fixed
from flightlens.operators import jobs as case_jobs
from flightlens.plans import views
from flightlens.plans.catalog import query
from flightlens.session import shared_dir
from flightlens.sources import binary, flight_logs, missions, registry

STAMP = "yyyy-MM-dd HH:mm:ss"
#: Running numbers whose lines are joined before a file is put together.
BLOCK = 1_000
#: Files made of telemetry: of every row what the formats hold, in text precision.
_TEL = f"""WITH {views.TELEMETRY}, f AS (
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1 AS seq, seq AS id, date_trunc('second', ts) AS ts, CAST(printf('%.7f', latitude) AS DOUBLE) AS latitude, CAST(printf('%.7f', longitude) AS DOUBLE) AS longitude,
         CAST(printf('%.2f', altitude_m) AS DOUBLE) AS altitude_m, ground_speed_mps, CAST(seq % 12 AS INTEGER) AS sats FROM tel WHERE altitude_m IS NOT NULL)"""
_CLOCK = "TIMESTAMP '2024-01-01 00:00:00'"


def text(column: str, digits: int = 7) -> Column:
    return fixed(F.col(column), digits)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.telemetry(spark, sf_dir).filter(F.col("altitude_m").isNotNull())
    return rows.withColumns({"lat": text("latitude"), "lon": text("longitude"), "alt": text("altitude_m", 2), "speed": text("ground_speed_mps", 1), "sats": (F.col("seq") % 12).cast("string"), "stamp": F.date_format("ts", STAMP)})


def written(rows: DataFrame, value: Column, head: tuple[str, ...] = (), sep: str = "\n") -> str:
    """The folder of files, one for each case_id of rows, with `head` and a line `value` for each row in seq order.

    One task puts a case's file together, from blocks of lines that many tasks have sorted.
    """
    path = f"{shared_dir(rows.sparkSession)}/files/{uuid.uuid4().hex}"
    lines = rows.select("case_id", F.lit(1).alias("part"), F.col("seq").cast("long").alias("seq"), value.alias("value"))
    if head:
        heads = rows.select("case_id").distinct().select("case_id", F.lit(0).alias("part"), F.posexplode(F.array(*[F.lit(h) for h in head])).alias("seq", "value"))
        lines = lines.unionByName(heads)
    line = F.struct("seq", F.coalesce("value", F.lit("")).alias("value"))
    blocks = lines.groupBy("case_id", "part", F.floor(F.col("seq") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    joined = blocks.select("case_id", "part", "block", F.array_join(F.col("lines.value"), sep).alias("value"))
    ordered = joined.repartition("case_id").sortWithinPartitions("case_id", "part", "block")
    ordered.select("case_id", "value").write.option("lineSep", sep).partitionBy("case_id").text(path)
    return path


def of_case(read: DataFrame) -> DataFrame:
    """Rows read from written files, with the case that their path names."""
    return read.withColumn("case_id", F.regexp_extract("file", r"case_id=(\d+)", 1).cast("long"))


def _dot(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _csv(*names: str) -> Column:
    return F.concat_ws(",", *names)


POINT = ("case_id", "seq", "ts", "latitude", "longitude", "altitude_m")


def _points(extra: str = "", ts: str = "ts", more: str = "") -> str:
    return _TEL + f" SELECT case_id, seq, {ts} AS ts, latitude, longitude, altitude_m{extra} FROM f{more}"


_SYNTHETIC = f"{_CLOCK} + to_seconds(seq)"


@query("read_srt", _points(", round(ground_speed_mps, 1) AS ground_speed_mps, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_raw"))
def read_srt(spark, sf_dir):
    block = _dot(F.col("seq").cast("string"), "\n00:00:00,000 --> 00:00:01,000\n", F.col("stamp"), "\n[latitude: ", F.col("lat"), "] [longitude: ", F.col("lon"), "] [altitude: ", F.col("alt"), "] [hspeed: ", F.col("speed"), "]")
    path = written(_rows(spark, sf_dir), block, sep="\n\n")
    return of_case(flight_logs.read_srt(spark, path)).select(*POINT, "ground_speed_mps", "ts_raw")


@query("read_srt_frames", _TEL + " SELECT case_id, id AS frame_index, latitude, longitude, altitude_m, CAST(100 + id % 5 AS VARCHAR) AS iso FROM f")
def read_srt_frames(spark, sf_dir):
    block = _dot(F.col("seq").cast("string"), "\n00:00:00,000 --> 00:00:01,000\nISO: ", (F.col("seq") % 5 + 100).cast("string"), " GPS(", F.col("lon"), ", ", F.col("lat"), ", 9) BAROMETER: ", F.col("alt"))
    found = of_case(flight_logs.read_srt_frames(spark, written(_rows(spark, sf_dir), block, sep="\n\n")))
    return found.select("case_id", "frame_index", "latitude", "longitude", "altitude_m", F.col("camera_settings.iso").alias("iso"))


@query("read_flight_csv", _points(", round(ground_speed_mps, 1) AS ground_speed_mps"))
def read_flight_csv(spark, sf_dir):
    path = written(_rows(spark, sf_dir), _csv("stamp", "lat", "lon", "alt", "speed"), ("sep=,", "DateTime,OSD.latitude,OSD.longitude,OSD.height [m],OSD.hSpeed"))
    return of_case(flight_logs.read_flight_csv(spark, path)).select(*POINT, "ground_speed_mps")


@query("read_dat_text", _points(ts=_CLOCK))
def read_dat_text(spark, sf_dir):
    path = written(_rows(spark, sf_dir), _dot("fix Lat=", F.col("lat"), " Lon=", F.col("lon"), " Alt=", F.col("alt")), ("no position here",))
    return of_case(flight_logs.read_dat_text(spark, path)).select(*POINT)


AP_FORMAT = ("FMT, 130, 50, GPS, QBLLeeB, TimeUS, Status, Lat, Lng, Alt, Spd, NSats", "FMT, 131, 9, EV, QB, TimeUS, Id")


def _ap_line() -> Column:
    return _dot("GPS, ", F.col("seq").cast("string"), ", 3, ", F.col("lat"), ", ", F.col("lon"), ", ", F.col("alt"), ", ", F.col("speed"), ", ", F.col("sats"))


@query("read_ap_log", _points(", round(ground_speed_mps, 1) AS ground_speed_mps, CAST(sats AS BIGINT) AS satellites_visible", _SYNTHETIC))
def read_ap_log(spark, sf_dir):
    path = written(_rows(spark, sf_dir), _ap_line(), AP_FORMAT)
    return of_case(flight_logs.read_ap_log(spark, path)).select(*POINT, "ground_speed_mps", "satellites_visible")


#: Every row whose id is a multiple of 5 is followed by an event line, by id: arming, failsafe, disarming.
_EVENT_LINES = """, ends AS (SELECT case_id, max(seq) AS n, arg_min(altitude_m, seq) AS first_alt FROM f GROUP BY case_id),
made AS (SELECT case_id, id, CASE id // 5 % 3 WHEN 0 THEN 'ARM' WHEN 1 THEN 'FAILSAFE' ELSE 'DISARM' END AS event_type FROM f WHERE id % 5 = 0),
lacking AS (SELECT case_id, -1 AS id, 'ARM' AS event_type FROM ends WHERE case_id NOT IN (SELECT case_id FROM made WHERE event_type = 'ARM')
  UNION ALL SELECT case_id, 1000000000000, 'DISARM' FROM ends WHERE case_id NOT IN (SELECT case_id FROM made WHERE event_type = 'DISARM')),
every AS (SELECT * FROM made UNION ALL SELECT * FROM lacking)"""
_EVENTS_READ = f"""SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY id) AS seq, event_type, CASE WHEN event_type = 'FAILSAFE' THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  CASE event_type WHEN 'DISARM' THEN {_CLOCK} + to_seconds(n + 1) WHEN 'FAILSAFE' THEN {_CLOCK} + to_seconds(n) ELSE {_CLOCK} END AS ts,
  CASE WHEN event_type IN ('ARM', 'DISARM') THEN 0.0 ELSE first_alt END AS altitude_m FROM every JOIN ends USING (case_id)"""
EVENT = ("case_id", "seq", "event_type", "severity", "ts", "altitude_m")


def _with_events(rows: DataFrame, line: Column, code: tuple[str, str, str], prefix: str) -> str:
    """Telemetry lines, and behind every fifth id an event line with one of three codes."""
    event = _dot(prefix, F.element_at(F.array(*[F.lit(c) for c in code]), (F.floor(F.col("seq") / 5) % 3 + 1).cast("int")))
    both = F.when(F.col("seq") % 5 == 0, F.array(line, event)).otherwise(F.array(line))
    return written(rows.withColumn("line", F.explode(both)).withColumn("seq", F.col("seq") * 2 + F.col("line").startswith(prefix).cast("int")), F.col("line"), AP_FORMAT)


@query("read_ap_events", _TEL + _EVENT_LINES + _EVENTS_READ)
def read_ap_events(spark, sf_dir):
    path = _with_events(_rows(spark, sf_dir), _ap_line(), ("10", "25", "11"), "EV, 5, ")
    return of_case(flight_logs.read_ap_events(spark, path)).select(*EVENT)


@query(
    "read_params",
    _TEL + """, first AS (SELECT case_id, id % 60 AS k, min(id) AS place, max(id) AS last FROM f GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY place) AS n, count(*) OVER (PARTITION BY case_id) AS total FROM first)
SELECT case_id, total, string_agg('P' || k || '=' || last, ',' ORDER BY 'P' || k) AS params FROM r WHERE n <= 51 GROUP BY case_id, total""",
)
def read_params(spark, sf_dir):
    line = _dot("PARM, 17, P", (F.col("seq") % 60).cast("string"), ", ", F.col("seq").cast("string"))
    found = of_case(flight_logs.read_params(spark, written(_rows(spark, sf_dir), line, ("# parameters",))))
    pairs = F.array_sort(F.map_entries("params"))
    return found.select("case_id", "total", F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",").alias("params"))


@query("read_px4_csv", _TEL + f" SELECT case_id, seq, {_SYNTHETIC} AS ts, latitude, longitude, round(altitude_m * 100 + 2000) / 100 AS altitude_m, CAST(sats AS BIGINT) AS satellites_visible FROM f")
def read_px4_csv(spark, sf_dir):
    whole = lambda c, factor: F.round(F.col(c).cast("double") * factor).cast("long").cast("string")
    rows = _rows(spark, sf_dir).withColumns({"lat": whole("lat", 1e7), "lon": whole("lon", 1e7), "alt": (F.round(F.col("alt").cast("double") * 1000) + 20_000).cast("long").cast("string")})
    path = written(rows, _csv("seq", "lat", "lon", "alt", "speed", "sats"), ("timestamp,lat,lon,alt,vel_m_s,satellites_used",))
    return of_case(flight_logs.read_px4_csv(spark, path)).select(*POINT, "satellites_visible")


def _daily(rows: DataFrame, document: Column) -> str:
    """A file for each case and day with one JSON document over its rows, of which `document` takes the array p."""
    point = F.struct("seq", F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"), F.col("lat").cast("double").alias("latitude"), F.col("lon").cast("double").alias("longitude"), F.col("alt").cast("double").alias("altitude"), F.col("speed").cast("double").alias("speed")).alias("x"))
    flights = rows.groupBy(F.concat_ws("-", "case_id", F.date_format("ts", "yyyyMMdd")).alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["x"]).alias("p"))
    return written(flights.withColumn("seq", F.lit(0)), document)


@query("read_parrot_json", _TEL.replace("row_number() OVER (PARTITION BY case_id ORDER BY seq)", "row_number() OVER (PARTITION BY case_id, CAST(ts AS DATE) ORDER BY seq)") + " SELECT case_id, seq, ts, latitude, longitude, altitude_m, round(ground_speed_mps, 1) AS ground_speed_mps FROM f")
def read_parrot_json(spark, sf_dir):
    path = _daily(_rows(spark, sf_dir), F.to_json(F.struct(F.lit("2024-01-01").alias("date"), F.col("p").alias("details"))))
    return of_case(flight_logs.read_parrot_json(spark, path)).select(*POINT, "ground_speed_mps")


@query("read_freeflight_serials", _TEL + " SELECT DISTINCT case_id, strftime(ts, '%Y%m%d') AS day, case_id || '-' || strftime(ts, '%Y%m%d') AS serial, 'Model ' || case_id AS product FROM f")
def read_freeflight_serials(spark, sf_dir):
    name = F.concat(F.lit("Model "), F.split_part("case_id", F.lit("-"), F.lit(1)))
    path = _daily(_rows(spark, sf_dir), F.to_json(F.struct(name.alias("product_name"), F.col("case_id").alias("serial_number"), F.col("p").alias("details"))))
    found = of_case(missions.read_freeflight_serials(spark, path))
    return found.select("case_id", F.regexp_extract("file", r"case_id=\d+-(\d+)", 1).alias("day"), "serial", "product")


def _blackbox_line() -> Column:
    return F.concat_ws(",", F.lit("G"), "seq", "sats", "lat", "lon", "alt", "speed")


@query("read_blackbox", _points(", round(ground_speed_mps, 1) AS ground_speed_mps, CAST(sats AS BIGINT) AS satellites_visible", _SYNTHETIC))
def read_blackbox(spark, sf_dir):
    path = written(_rows(spark, sf_dir), _blackbox_line(), ("H Product:Blackbox", "H Craft name:x"))
    return of_case(flight_logs.read_blackbox(spark, path)).select(*POINT, "ground_speed_mps", "satellites_visible")


@query("read_blackbox_events", _TEL + _EVENT_LINES + _EVENTS_READ)
def read_blackbox_events(spark, sf_dir):
    path = _with_events(_rows(spark, sf_dir), _blackbox_line(), ("0", "FAILSAFE", "1"), "E,")
    return of_case(flight_logs.read_blackbox_events(spark, path)).select(*EVENT)


_CONFIG = """, last AS (SELECT case_id, id % 40 AS k, max(id) AS v FROM f GROUP BY 1, 2)
SELECT case_id, string_agg('k' || k || '=' || v, ',' ORDER BY 'k' || k) || ',zz=' || case_id AS config FROM last GROUP BY case_id"""


def _config_text(found: DataFrame) -> DataFrame:
    return found.select("case_id", F.array_join(F.transform(F.array_sort(F.map_entries("config")), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",").alias("config"))


def _set_lines(spark: SparkSession, sf_dir: str, last: str) -> str:
    rows = _rows(spark, sf_dir).withColumn("line", F.explode(F.array(_dot("set k", (F.col("seq") % 40).cast("string"), " = ", F.col("seq").cast("string")), _dot(last, F.col("case_id").cast("string")))))
    return written(rows.withColumn("seq", F.col("seq") * 2), F.col("line"))


@query("read_blackbox_config", _TEL + _CONFIG)
def read_blackbox_config(spark, sf_dir):
    return _config_text(of_case(flight_logs.read_blackbox_config(spark, _set_lines(spark, sf_dir, "H zz:"))))


@query("read_cli_config", (_TEL + _CONFIG).replace("string_agg('k'", "'craft_name=' || case_id || ',' || string_agg('k'").replace(" || ',zz=' || case_id", ""))
def read_cli_config(spark, sf_dir):
    return _config_text(of_case(missions.read_cli_config(spark, _set_lines(spark, sf_dir, "name "))))


# ---------------------------------------------------------------- plans

_WP = f"""WITH {views.WAYPOINTS}, w AS (
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY idx) AS idx, command, CAST(printf('%.7f', latitude) AS DOUBLE) AS latitude, CAST(printf('%.7f', longitude) AS DOUBLE) AS longitude, CAST(printf('%.2f', altitude_m) AS DOUBLE) AS altitude_m FROM wp WHERE altitude_m IS NOT NULL)"""
WAYPOINT = ("case_id", "idx", "command", "latitude", "longitude", "altitude_m", "speed_mps")


def _plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.waypoints(spark, sf_dir).filter(F.col("altitude_m").isNotNull())
    return rows.withColumn("seq", F.col("idx")).withColumns({"lat": text("latitude"), "lon": text("longitude"), "alt": text("altitude_m", 2)})


def _plan_documents(spark: SparkSession, sf_dir: str, point: Column, document: Column) -> str:
    """A file for each case's plan with one document over its waypoints, of which `document` takes the array p."""
    plans = _plan_rows(spark, sf_dir).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("x")))), lambda p: p["x"]).alias("p"))
    return written(plans.withColumn("seq", F.lit(0)), document)


def _plan_sql(command: str = "'WAYPOINT'", speed: float = 12.0, first: int = 0) -> str:
    return _WP + f" SELECT case_id, idx + {first} AS idx, {command} AS command, latitude, longitude, altitude_m, CAST({speed} AS DOUBLE) AS speed_mps FROM w"


@query("read_wpl", _plan_sql("CASE WHEN idx = 1 THEN 'HOME' WHEN idx % 4 = 0 THEN 'LAND' ELSE 'WAYPOINT' END", 12.0, -1).replace("idx % 4", "(idx - 1) % 4"))
def read_wpl(spark, sf_dir):
    rows = _plan_rows(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy("seq")) - 1)
    code = F.when(F.col("k") % 4 == 0, "21").otherwise("16")
    path = written(rows, F.concat_ws("\t", "k", F.lit("0"), F.lit("3"), code, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), "lat", "lon", "alt", F.lit("1")), ("QGC WPL 110",))
    return of_case(missions.read_wpl(spark, path)).select(*WAYPOINT)


def _degrees() -> list[Column]:
    return [F.col(c).cast("double") for c in ("lat", "lon", "alt")]


@query("read_qgc_plan", _plan_sql("'WAYPOINT'", 14.0) + " UNION ALL SELECT DISTINCT case_id, 0, 'HOME', 12.5, 70.25, 3.0, CAST(NULL AS DOUBLE) FROM w")
def read_qgc_plan(spark, sf_dir):
    zero = F.lit(0.0)
    item = F.struct(F.lit(16).alias("command"), F.array(zero, zero, zero, zero, *_degrees()).alias("params"), F.lit(True).alias("autoContinue"))
    mission = F.struct(F.array(F.lit(12.5), F.lit(70.25), F.lit(3.0)).alias("plannedHomePosition"), F.lit(14.0).alias("cruiseSpeed"), F.col("p").alias("items"))
    path = _plan_documents(spark, sf_dir, item, F.to_json(F.struct(F.lit("QGC").alias("groundStation"), mission.alias("mission"))))
    return of_case(missions.read_qgc_plan(spark, path)).select(*WAYPOINT)


@query("read_plan_fences", _WP + " SELECT case_id, 'QGC-FENCE-1' AS zone_id, 'RED' AS zone_class, count(*) AS corners, round(sum(latitude), 6) AS latitudes FROM w GROUP BY case_id")
def read_plan_fences(spark, sf_dir):
    fence = F.struct(F.array(F.struct(F.col("p").alias("polygon"), F.lit(False).alias("inclusion"))).alias("polygons"))
    path = _plan_documents(spark, sf_dir, F.array(*_degrees()[:2]), F.to_json(F.struct(F.lit("QGC").alias("groundStation"), fence.alias("geoFence"))))
    total = F.aggregate("coordinates", F.lit(0.0), lambda s, c: s + c[0])
    return of_case(missions.read_plan_fences(spark, path)).select("case_id", "zone_id", "zone_class", F.size("coordinates").cast("long").alias("corners"), F.round(total, 6).alias("latitudes"))


@query("read_wpml", _plan_sql("'WAYPOINT'", 7.5))
def read_wpml(spark, sf_dir):
    mark = _dot("<Placemark><Point><coordinates>", F.col("lon"), ",", F.col("lat"), "</coordinates></Point><wpml:executeHeight>", F.col("alt"), "</wpml:executeHeight><wpml:waypointSpeed>7.5</wpml:waypointSpeed></Placemark>")
    path = _plan_documents(spark, sf_dir, mark, _dot("<kml><Document>", F.array_join("p", ""), "</Document></kml>"))
    return of_case(missions.read_wpml(spark, path)).select(*WAYPOINT)


def _mission_json(spark: SparkSession, sf_dir: str, lat: str, lon: str, inside: bool) -> str:
    point = F.struct(F.col("lat").cast("double").alias(lat), F.col("lon").cast("double").alias(lon), F.col("alt").cast("double").alias("alt"), F.lit("hover").alias("action"))
    body = F.struct(F.col("p").alias("waypoints"))
    home = F.struct(F.lit(10.5).alias("lat"), F.lit(70.5).alias("lon")).alias("home_location")
    return _plan_documents(spark, sf_dir, point, F.to_json(F.struct(body.alias("mission") if inside else F.col("p").alias("points"), home)))


@query("read_gspro", _plan_sql("'HOVER'", 8.0))
def read_gspro(spark, sf_dir):
    return of_case(missions.read_gspro(spark, _mission_json(spark, sf_dir, "lat", "lng", True))).select(*WAYPOINT)


@query("read_flightplan_json", _plan_sql("'HOVER'", 10.0))
def read_flightplan_json(spark, sf_dir):
    return of_case(missions.read_flightplan_json(spark, _mission_json(spark, sf_dir, "latitude", "longitude", False))).select(*WAYPOINT)


@query("read_litchi_mission_json", _plan_sql("'HOVER'", 5.0))
def read_litchi_mission_json(spark, sf_dir):
    return of_case(missions.read_litchi_mission_json(spark, _mission_json(spark, sf_dir, "lat", "lon", True))).select(*WAYPOINT)


@query("json_homes", _WP + " SELECT DISTINCT case_id, CAST(10.5 AS DOUBLE) AS latitude, CAST(70.5 AS DOUBLE) AS longitude FROM w")
def json_homes(spark, sf_dir):
    return of_case(missions.json_homes(spark, _mission_json(spark, sf_dir, "lat", "lon", True))).select("case_id", "latitude", "longitude")


@query("read_inav_mission", _plan_sql("'LOITER'", 9.0))
def read_inav_mission(spark, sf_dir):
    path = written(_plan_rows(spark, sf_dir), F.concat_ws(",", "seq", F.lit("loiter"), "lat", "lon", "alt", F.lit("9")), ("# mission",))
    return of_case(missions.read_inav_mission(spark, path)).select(*WAYPOINT)


@query("read_inav_xml", _plan_sql("'WAYPOINT'", 6.0))
def read_inav_xml(spark, sf_dir):
    item = _dot('<missionitem no="', F.col("seq").cast("string"), '" action="WAYPOINT" lat="', F.col("lat"), '" lon="', F.col("lon"), '" alt="', F.col("alt"), '" speed="6"/>')
    path = _plan_documents(spark, sf_dir, item, _dot("<mission>", F.array_join("p", ""), "</mission>"))
    return of_case(missions.read_inav_xml(spark, path)).select(*WAYPOINT)


@query("read_litchi_mission", _plan_sql("'WAYPOINT'", 4.5))
def read_litchi_mission(spark, sf_dir):
    path = written(_plan_rows(spark, sf_dir), F.concat_ws(",", "lat", "lon", "alt", F.lit("4.5")), ("latitude,longitude,altitude(m),speed(m/s)",))
    return of_case(missions.read_litchi_mission(spark, path)).select(*WAYPOINT)


@query("home_locations", _WP + " SELECT DISTINCT case_id, 'QGC' AS source, CAST(12.5 AS DOUBLE) AS latitude, CAST(70.25 AS DOUBLE) AS longitude FROM w")
def home_locations(spark, sf_dir):
    mission = F.struct(F.array(F.lit(12.5), F.lit(70.25), F.lit(3.0)).alias("plannedHomePosition"), F.col("p").alias("items"))
    path = _plan_documents(spark, sf_dir, F.struct(F.lit(16).alias("command"), F.array(*_degrees()).alias("params")), F.to_json(F.struct(mission.alias("mission"))))
    return of_case(missions.home_locations(missions.read_qgc_plan(spark, path), "QGC")).select("case_id", "source", "latitude", "longitude")


# ---------------------------------------------------------------- companion apps


@query("read_litchi_csv", _points(", round(ground_speed_mps, 1) AS ground_speed_mps"))
def read_litchi_csv(spark, sf_dir):
    track, _ = missions.read_litchi_csv(spark, written(_rows(spark, sf_dir), _csv("lat", "lon", "alt", "speed", "stamp"), ("latitude,longitude,altitude(m),speed(m/s),datetime(utc)",)))
    return of_case(track).select(*POINT, "ground_speed_mps")


@query("litchi_operators", _TEL + " SELECT case_id, min(id) % 90 + CAST(1.5 AS DOUBLE) AS latitude, CAST(72 AS DOUBLE) AS longitude, 'PHONE_GPS' AS source FROM f GROUP BY case_id")
def litchi_operators(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("phone", (F.col("seq") % 90 + 1.5).cast("string"))
    _, homes = missions.read_litchi_csv(spark, written(rows, F.concat_ws(",", "lat", "lon", "phone", F.lit("72"), F.lit("1"), F.lit("2")), ("latitude,longitude,phone_latitude,phone_longitude,home_latitude,home_longitude",)))
    return of_case(homes).select("case_id", "latitude", "longitude", "source")


@query("read_mobile_flight_txt", _points(more=" WHERE seq < 200"))
def read_mobile_flight_txt(spark, sf_dir):
    track, _, _ = missions.read_mobile_flight_txt(spark, written(_rows(spark, sf_dir), _csv("stamp", "lat", "lon", "alt"), ("datetime,latitude,longitude,altitude",)))
    return of_case(track).select(*POINT)


@query("read_autel_csv", _points(", round(ground_speed_mps, 1) AS ground_speed_mps"))
def read_autel_csv(spark, sf_dir):
    track, _, _ = missions.read_autel_csv(spark, written(_rows(spark, sf_dir), _csv("stamp", "lat", "lon", "alt", "speed"), ("timestamp,drone_lat,drone_lon,altitude,speed",)))
    return of_case(track).select(*POINT, "ground_speed_mps")


@query("autel_serials", _TEL + " SELECT case_id, 'SN-' || min(id) AS serial FROM f GROUP BY case_id")
def autel_serials(spark, sf_dir):
    _, _, serials = missions.read_autel_csv(spark, written(_rows(spark, sf_dir), F.concat_ws(",", "lat", "lon", _dot("SN-", F.col("seq").cast("string"))), ("drone_lat,drone_lon,sn",)))
    return of_case(serials).select("case_id", "serial")


@query("read_text_dump", _TEL + " SELECT case_id, count(*) AS lines, string_agg(DISTINCT CASE id % 3 WHEN 0 THEN 'DJI' WHEN 1 THEN 'PX4' END, ',' ORDER BY CASE id % 3 WHEN 0 THEN 'DJI' WHEN 1 THEN 'PX4' END) AS brands FROM f GROUP BY case_id")
def read_text_dump(spark, sf_dir):
    named = F.when(F.col("seq") % 3 == 0, "frame of a DJI link").when(F.col("seq") % 3 == 1, "PX4 heartbeat").otherwise("noise")
    found = of_case(missions.read_text_dump(spark, written(_rows(spark, sf_dir), named)))
    return found.select("case_id", "lines", F.array_join("brands", ",").alias("brands"))


# ---------------------------------------------------------------- files as evidence

_FILES = _TEL + ", t AS (SELECT case_id, string_agg('row ' || id || chr(10), '' ORDER BY id) AS content FROM f GROUP BY case_id)"


def _row_files(spark: SparkSession, sf_dir: str) -> str:
    return written(_rows(spark, sf_dir), _dot("row ", F.col("seq").cast("string")))


@query("scan_evidence", _FILES + " SELECT case_id, CAST(strlen(content) AS BIGINT) AS byte_count FROM t")
def scan_evidence(spark, sf_dir):
    found = binary.scan_evidence(spark, _row_files(spark, sf_dir)).withColumnRenamed("path", "file")
    return of_case(found).select("case_id", "byte_count")


@query("manifest_job", _FILES + " SELECT case_id, CAST(strlen(content) AS BIGINT) AS byte_count, sha256(content) AS sha256, md5(content) AS md5, 'LOGS' AS category FROM t")
def manifest_job(spark, sf_dir):
    items, _ = case_jobs.manifest(spark, _row_files(spark, sf_dir))
    return of_case(items.drop("case_id").withColumnRenamed("path", "file")).select("case_id", "byte_count", "sha256", "md5", "category")


@query("manifest_totals", _FILES + " SELECT CAST(7 AS BIGINT) AS case_id, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM t")
def manifest_totals(spark, sf_dir):
    return case_jobs.manifest(spark, _row_files(spark, sf_dir), 7)[1]


@query("new_evidence", _FILES + " SELECT case_id, sha256(content) AS sha256 FROM t WHERE case_id % 2 = 1")
def new_evidence(spark, sf_dir):
    items, _ = case_jobs.manifest(spark, _row_files(spark, sf_dir))
    found = of_case(items.drop("case_id").withColumnRenamed("path", "file")).select("case_id", "sha256")
    return registry.new_evidence(found.union(found), found.filter("case_id % 2 = 0"))


@query("batch_ingest", _points(", 'DJI_AIRDATA_RECORD' AS source_channel"))
def batch_ingest(spark, sf_dir):
    path = written(_rows(spark, sf_dir), _csv("stamp", "lat", "lon", "alt"), ("DateTime,OSD.latitude,OSD.longitude,OSD.height [m]",))
    return of_case(registry.Registry().read_all(spark, path)).select(*POINT, "source_channel")


@query("file_metadata", _TEL + " SELECT case_id, count(*) AS points, CAST(count_if(id % 5 = 0) AS BIGINT) AS events, max(altitude_m) AS max_altitude_m, min(ts) AS start_ts, max(ts) AS end_ts FROM f GROUP BY case_id")
def file_metadata(spark, sf_dir):
    track = flight_logs.read_flight_csv(spark, written(_rows(spark, sf_dir), _csv("stamp", "lat", "lon", "alt"), ("DateTime,OSD.latitude,OSD.longitude,OSD.height [m]",)))
    marks = _rows(spark, sf_dir).filter("seq % 5 = 0").select(F.col("case_id").alias("case"), F.lit("EV").alias("event_type"))
    events = marks.join(of_case(track.select("file").distinct()), F.col("case") == F.col("case_id")).select("file", "event_type")
    return of_case(case_jobs.file_metadata(track, events)).select("case_id", "points", "events", "max_altitude_m", "start_ts", "end_ts")
