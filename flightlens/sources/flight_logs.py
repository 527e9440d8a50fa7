"""Text flight logs as telemetry and event rows. Files without times take a base time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightlens.functions.geo import feet_to_metres, off_null_island, scaled_degrees, scaled_metres
from flightlens.sources.lines import NUMBER, at, clock, fields, find_column, named_column, number, numbered, parse_ts, read_lines, read_table, read_whole

COLUMNS = ("file", "seq", "ts", "ts_raw", "latitude", "longitude", "altitude_m", "ground_speed_mps", "pitch_deg", "yaw_deg", "battery_pct", "satellites_visible", "source_channel")
BASE = "2024-01-01 00:00:00"


def _telemetry(rows: DataFrame, channel: str, seconds: Column | None = None, base: str = BASE, **columns: Column) -> DataFrame:
    """Rows in file order in the columns of telemetry; `seconds`: of a synthetic clock, by place."""
    rows = numbered(rows.withColumns(columns))
    if seconds is not None:
        rows = rows.withColumn("ts", clock(base, seconds)).withColumn("ts_raw", F.lit(None).cast("string"))
    missing = {"altitude_m": 0.0, "ground_speed_mps": 0.0, "pitch_deg": 0.0, "yaw_deg": 0.0, "battery_pct": None, "satellites_visible": None}
    for name, value in missing.items():
        if name not in columns:
            rows = rows.withColumn(name, F.lit(value).cast("double"))
    return rows.withColumn("satellites_visible", F.col("satellites_visible").cast("int")).withColumn("source_channel", F.lit(channel)).select(*COLUMNS)


def _tag(text: Column, names: str, number_pattern: str = NUMBER) -> Column:
    return number(F.regexp_extract(text, rf"(?i)(?:{names})[:\s]+{number_pattern}", 1))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle telemetry: blocks of at least three lines with a latitude and a longitude."""
    blocks = read_lines(spark, path, "\n\n").filter(F.size(F.split(F.trim("line"), "\n")) >= 3)
    text, exact = F.col("line"), r"([+-]?\d+\.\d+)"
    raw = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1)
    raw = F.when(raw != "", F.concat(F.regexp_replace(raw, r"\s+", "T"), F.lit("Z")))
    lat, lon = _tag(text, "latitude|lat", exact), _tag(text, "longitude|lon", exact)
    return _telemetry(
        blocks.filter(lat.isNotNull() & lon.isNotNull()), "DJI_SRT_STREAM",
        ts_raw=raw, ts=parse_ts(raw), latitude=lat, longitude=lon, altitude_m=F.coalesce(_tag(text, "altitude|alt|rel_alt"), F.lit(0.0)),
        ground_speed_mps=F.coalesce(_tag(text, "hspeed|speed"), F.lit(0.0)), pitch_deg=F.coalesce(_tag(text, "pitch"), F.lit(0.0)), yaw_deg=F.coalesce(_tag(text, "yaw"), F.lit(0.0)),
    )


def read_srt_frames(spark: SparkSession, path: str) -> DataFrame:
    """Video frames of subtitles: position from GPS(a, b[, c]) with the axes told apart, barometer and camera settings.

    The pair is longitude first unless that can't be: a beyond 90 means longitude first;
    else the larger of the two is the longitude.
    """
    text = F.col("line")
    gps = rf"GPS\s*\(\s*{NUMBER}\s*,\s*{NUMBER}(?:\s*,\s*{NUMBER})?\s*\)"
    a, b, c = (number(F.regexp_extract(text, gps, i)) for i in (1, 2, 3))
    swap = (F.abs(a) > 90) | ((F.abs(b) <= 90) & (F.abs(a) > F.abs(b)))
    frames = numbered(read_lines(spark, path, "\n\n").filter(text.rlike(gps)), 1, "place")
    index = F.coalesce(F.regexp_extract(text, r"(?:^|\n)\s*(\d+)\s*\n", 1).try_cast("long"), F.col("place"))
    return frames.select(
        "file", index.alias("frame_index"), F.when(swap, b).otherwise(a).alias("latitude"), F.when(swap, a).otherwise(b).alias("longitude"),
        F.coalesce(number(F.regexp_extract(text, rf"(?i)barometer[:\s]+{NUMBER}", 1)), c).alias("altitude_m"),
        F.struct(F.regexp_extract(text, r"ISO[:\s]+(\d+)", 1).alias("iso"), F.regexp_extract(text, r"Shutter[:\s]+([\d./]+)", 1).alias("shutter"), F.regexp_extract(text, r"(?i)Fnum[:\s]+([\d.]+)", 1).alias("fnum")).alias("camera_settings"),
    )


def read_flight_csv(spark: SparkSession, path: str) -> DataFrame:
    """Decoded flight records: columns found by what their names hold, feet turned to metres; all rows kept."""
    rows, h, p = read_table(spark, path), F.col("header"), F.col("parts")
    lat = number(at(p, find_column(h, "osd.latitude", "latitude", "lat")))
    lon = number(at(p, find_column(h, "osd.longitude", "longitude", "lon")))
    feet = number(at(p, find_column(h, "osd.height [ft]", "height [ft]", "altitude [ft]")))
    metres = number(at(p, find_column(h, "osd.height [m]", "osd.height", "osd.altitude", "altitude", "height")))
    time, day = at(p, find_column(h, "custom.updatetime", "datetime", "timestamp", "time", "osd.flytime")), at(p, find_column(h, "custom.date"))
    raw = F.trim(F.concat_ws(" ", F.when(day != "", day), time))
    return _telemetry(
        rows.filter(off_null_island(lat, lon, 1e-4)), "DJI_AIRDATA_RECORD",
        ts_raw=raw, ts=parse_ts(raw), latitude=F.round(lat, 7), longitude=F.round(lon, 7), altitude_m=F.coalesce(feet_to_metres(feet), F.round(metres, 2), F.lit(0.0)),
        ground_speed_mps=F.round(F.coalesce(number(at(p, find_column(h, "osd.hspeed", "speed"))), F.lit(0.0)), 2), battery_pct=number(at(p, find_column(h, "osd.battery", "battery"))),
    )


def read_dat_text(spark: SparkSession, path: str, base: str = BASE) -> DataFrame:
    """Positions written as text into binary logs; without an altitude 10 m."""
    tag = lambda name, pattern: number(F.regexp_extract("line", rf"(?i){name}[=:\s]+{pattern}", 1))
    exact = r"([+-]?\d+\.\d+)"
    lat, lon = tag("lat(?:itude)?", exact), tag("lon(?:gitude)?", exact)
    rows = read_lines(spark, path).filter(lat.isNotNull() & lon.isNotNull())
    return _telemetry(rows, "DJI_DAT_PAYLOAD", F.lit(0), base, latitude=lat, longitude=lon, altitude_m=F.coalesce(tag("alt(?:itude)?", NUMBER), F.lit(10.0)))


def read_ap_log(spark: SparkSession, path: str, base: str = BASE) -> DataFrame:
    """ASCII autopilot logs: fields named by FMT lines; GPS rows, or POS rows in files without any.

    A row with fewer fields than its FMT line names is searched for a neighbouring pair
    that can be a latitude and a longitude.
    """
    lines = read_lines(spark, path).withColumn("parts", fields(F.col("line"))).withColumn("msg", F.upper(F.get("parts", F.lit(0))))
    formats = lines.filter((F.col("msg") == "FMT") & (F.size("parts") >= 6))
    names = formats.groupBy("file", F.upper(F.get("parts", F.lit(3))).alias("msg")).agg(F.max_by(F.transform(F.slice("parts", 6, 1000), lambda x: F.lower(x)), F.struct("block", "id")).alias("names"))
    rows = lines.filter(F.col("msg").isin("GPS", "POS"))
    kinds = rows.groupBy("file").agg(F.max(F.col("msg") == "GPS").alias("has_gps"))
    rows = rows.join(kinds, "file").filter(F.col("msg") == F.when(F.col("has_gps"), "GPS").otherwise("POS")).join(names, ["file", "msg"], "left")
    values = F.slice("parts", 2, 1000)
    whole = F.coalesce((F.size("names") > 0) & (F.size(values) >= F.size("names")), F.lit(False))
    named = lambda *keys: number(at(values, named_column(F.col("names"), *keys)))
    numbers = F.transform(values, lambda v: v.try_cast("double"))
    pairs = F.transform(
        F.zip_with(numbers, F.slice(numbers, 2, 1000), lambda x, y: F.struct(scaled_degrees(x, 90).alias("a"), scaled_degrees(y, 180).alias("b"))),
        lambda p, i: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.get(numbers, i + 2).alias("alt")),
    )
    pair = F.get(F.filter(pairs, lambda p: F.abs(p["a"]).between(8, 85) & F.abs(p["b"]).between(20, 180)), F.lit(0))
    lat = F.when(whole, scaled_degrees(named("lat", "latitude"), 90)).otherwise(pair["a"])
    lon = F.when(whole, scaled_degrees(named("lng", "lon", "longitude"), 180)).otherwise(pair["b"])
    found = _telemetry(
        rows.filter(lat.isNotNull() & lon.isNotNull()), "ARDUPILOT", F.col("seq"), base,
        latitude=F.round(lat, 7), longitude=F.round(lon, 7), altitude_m=F.round(F.coalesce(F.when(whole, named("alt", "altitude")).otherwise(pair["alt"]), F.lit(0.0)), 2),
        ground_speed_mps=F.round(F.coalesce(F.when(whole, named("spd", "speed")), F.lit(0.0)), 2), satellites_visible=F.when(whole, named("nsats", "satellites")),
    )
    return found


def _placed(events: DataFrame, track: DataFrame) -> DataFrame:
    """Events (file, place, event_type, at_last, description) with times and positions of their file's first or last point."""
    point = F.struct("ts", "latitude", "longitude", "altitude_m")
    ends = track.groupBy("file").agg(F.min_by(point, "seq").alias("first"), F.max_by(point, "seq").alias("last"))
    disarm = F.col("event_type") == "DISARM"
    ts = F.when(disarm, F.col("last.ts") + F.expr("interval 1 second")).when(F.col("at_last"), F.col("last.ts")).otherwise(F.col("first.ts"))
    seen = events.groupBy("file").agg(F.bool_or(F.col("event_type") == "ARM").alias("arm"), F.bool_or(disarm).alias("disarm"))
    kind = lambda name, place, text: F.struct(F.lit(name).alias("event_type"), F.lit(place).cast("long").alias("place"), F.lit(text).alias("description"))
    absent = ends.select("file").join(seen, "file", "left").select(
        "file", F.explode(F.array_compact(F.array(F.when(~F.coalesce("arm", F.lit(False)), kind("ARM", -1, "Arming verified by telemetry")), F.when(~F.coalesce("disarm", F.lit(False)), kind("DISARM", 1 << 60, "Disarm at the end of telemetry"))))).alias("e")
    )
    made = absent.select("file", "e.place", "e.event_type", F.lit(False).alias("at_last"), "e.description")
    placed = events.unionByName(made).join(ends, "file", "left")
    where = lambda c: F.when(disarm, F.col(f"last.{c}")).otherwise(F.col(f"first.{c}"))
    return placed.select(
        "file", F.row_number().over(Window.partitionBy("file").orderBy("place")).alias("seq"), ts.alias("ts"), "event_type",
        F.when(F.col("event_type") == "FAILSAFE", "CRITICAL").otherwise("INFO").alias("severity"), "description",
        where("latitude").alias("latitude"), where("longitude").alias("longitude"), F.when(F.col("event_type").isin("ARM", "DISARM"), 0.0).otherwise(F.col("first.altitude_m")).alias("altitude_m"),
    )


def read_ap_events(spark: SparkSession, path: str, base: str = BASE) -> DataFrame:
    """Arm, disarm, failsafe and automatic-mode events of ASCII logs; modes without an event type are left out.

    Files with telemetry but without an ARM or DISARM get one at their ends.
    """
    lines = numbered(read_lines(spark, path).filter(F.col("line").rlike("^(EV|MODE),")), 0, "place").withColumn("parts", fields(F.col("line"))).filter(F.size("parts") >= 3)
    code = F.get("parts", F.lit(2))
    event = F.when(code == "11", "DISARM").when(code == "25", "FAILSAFE").otherwise("ARM")
    is_event = F.col("line").startswith("EV,")
    kind = F.when(is_event, event).when(code.contains("AUTO"), "WAYPOINT_REACHED")
    text = F.when(~is_event, F.concat(F.lit("Flight Mode Switched to: "), code)).otherwise(F.concat(F.lit("Autopilot event "), code))
    rows = lines.filter(kind.isNotNull()).select("file", "place", kind.alias("event_type"), (kind == "FAILSAFE").alias("at_last"), text.alias("description"))
    return _placed(rows, read_ap_log(spark, path, base))


def read_params(spark: SparkSession, path: str, most: int = 51) -> DataFrame:
    """(file, params, total): the first `most` different parameters of a file as a map, of PARM lines or separated pairs."""
    lines = read_lines(spark, path).withColumn("text", F.trim("line")).filter(~F.col("text").startswith("#"))
    parm = F.col("text").startswith("PARM,")
    p = fields(F.col("text"))
    timed = F.size(p) >= 4
    sep = F.when(F.col("text").contains(","), ",").when(F.col("text").contains("\t"), "\t").otherwise("=")
    name = F.when(parm, F.get(p, F.when(timed, 2).otherwise(1))).otherwise(F.trim(F.split_part("text", sep, F.lit(1))))
    value = F.when(parm, F.get(p, F.when(timed, 3).otherwise(2))).otherwise(F.trim(F.expr("substring(text, locate(sep, text) + 1)")))
    pairs = lines.filter(F.col("text").rlike("[,\t=]")).withColumn("sep", sep).withColumns({"name": name, "value": value}).filter((F.col("name") != "") & (F.col("name") != "FMT"))
    first = pairs.groupBy("file", "name").agg(F.min(F.struct("block", "id")).alias("place"), F.max_by("value", F.struct("block", "id")).alias("value"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("place"))).withColumn("total", F.count("*").over(Window.partitionBy("file")))
    kept = ranked.filter(F.col("k") <= most)
    return kept.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("params"), F.max("total").alias("total"))


def read_px4_csv(spark: SparkSession, path: str, base: str = BASE) -> DataFrame:
    """Autopilot tables by exact header names; 1e-7 degrees and millimetres scaled by range; one row a second."""
    rows, h, p = read_table(spark, path), F.col("header"), F.col("parts")
    get = lambda *names: number(at(p, named_column(h, *names)))
    lat, lon = scaled_degrees(get("lat", "latitude"), 90), scaled_degrees(get("lon", "longitude"), 180)
    return _telemetry(
        rows.filter(off_null_island(lat, lon)), "PX4_CSV_STREAM", F.col("seq"), base,
        latitude=lat, longitude=lon, altitude_m=F.coalesce(scaled_metres(get("alt", "altitude")), F.lit(0.0)), ground_speed_mps=F.coalesce(get("vel_m_s", "speed"), F.lit(0.0)), satellites_visible=get("satellites_used", "satellites"),
    )


_POINT = "timestamp_utc string, timestamp string, latitude double, lat double, longitude double, lon double, altitude double, alt double, speed double, battery_level double, battery double"
_POINTS = ", ".join(f"{name} array<struct<{_POINT.replace(' ', ':').replace(',:', ', ')}>>" for name in ("details", "points", "records", "telemetry", "flight_data"))
_LOG = f"product_name string, run_id string, serial_number string, serial string, date string, {_POINTS}"


def read_parrot_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON flight dumps, behind any leading text: points under several names; the no-fix value 500 is dropped."""
    data = F.from_json(F.regexp_extract("text", r"(?s)(\{.*)", 1), _LOG)
    lists = [F.when(F.size(F.col(f"d.{c}")) > 0, F.col(f"d.{c}")) for c in ("details", "points", "records", "telemetry", "flight_data")]
    rows = read_whole(spark, path).withColumn("d", data).select("file", F.col("d.date").alias("date"), F.posexplode(F.coalesce(*lists)).alias("id", "p")).withColumn("block", F.lit(0))
    lat, lon = F.coalesce("p.latitude", "p.lat"), F.coalesce("p.longitude", "p.lon")
    good = (lat != 0) & (lon != 0) & (lat != 500) & (lon != 500)
    raw = F.coalesce("p.timestamp_utc", "p.timestamp", "date")
    return _telemetry(
        rows.filter(good), "PARROT_PUD_TELEMETRY", ts_raw=raw, ts=parse_ts(raw), latitude=lat, longitude=lon, altitude_m=F.coalesce("p.altitude", "p.alt", F.lit(0.0)), ground_speed_mps=F.coalesce("p.speed", F.lit(0.0)), battery_pct=F.coalesce("p.battery_level", "p.battery")
    )


def read_blackbox(spark: SparkSession, path: str, base: str = BASE) -> DataFrame:
    """GPS frames of text blackboxes; a satellite count of at most 60 in the third field shifts the others."""
    rows = read_lines(spark, path).filter(F.col("line").rlike("^(G|GPS),|GPS_coord") & ~F.col("line").startswith("H ")).withColumn("parts", fields(F.col("line"))).filter(F.size("parts") >= 5)
    p = F.col("parts")
    sats = F.get(p, F.lit(2)).try_cast("int")
    shift = F.when(F.col("line").startswith("G,") & (F.size(p) >= 7) & (sats <= 60), 1).otherwise(0)
    value = lambda i: number(F.get(p, shift + i))
    lat, lon = scaled_degrees(value(2), 90), scaled_degrees(value(3), 180)
    return _telemetry(
        rows.filter(off_null_island(lat, lon)), "BETAFLIGHT_BLACKBOX_GPS", F.col("seq"), base,
        latitude=lat, longitude=lon, altitude_m=F.coalesce(value(4), F.lit(0.0)), ground_speed_mps=F.coalesce(value(5), F.lit(0.0)), satellites_visible=F.when(shift == 1, sats),
    )


def read_blackbox_events(spark: SparkSession, path: str, base: str = BASE) -> DataFrame:
    """Disarm, arm and failsafe events of text blackboxes; others have no event type and are left out."""
    lines = numbered(read_lines(spark, path).filter(F.col("line").startswith("E,")), 0, "place").withColumn("parts", fields(F.col("line")))
    text, code = F.upper(F.concat_ws(" ", F.slice("parts", 2, 1000))), F.get("parts", F.lit(1))
    kind = F.when(text.contains("DISARM") | (code == "1"), "DISARM").when(text.contains("ARM") | (code == "0"), "ARM").when(text.contains("FAILSAFE"), "FAILSAFE")
    rows = lines.filter(kind.isNotNull()).select("file", "place", kind.alias("event_type"), (kind == "FAILSAFE").alias("at_last"), F.concat(F.lit("Blackbox event: "), text).alias("description"))
    return _placed(rows, read_blackbox(spark, path, base))


def read_blackbox_config(spark: SparkSession, path: str) -> DataFrame:
    """(file, config): header and set lines as a map; the last value of a name wins."""
    text = F.trim("line")
    lines = read_lines(spark, path).filter(F.col("line").rlike("^(H .*:|set .*=|feature .*=)"))
    name = F.trim(F.regexp_extract(text, r"^(?:H |set |feature )([^:=]*)[:=]", 1))
    value = F.trim(F.regexp_extract(text, r"^(?:H |set |feature )[^:=]*[:=](.*)$", 1))
    last = lines.select("file", name.alias("name"), value.alias("value"), "block", "id").groupBy("file", "name").agg(F.max_by("value", F.struct("block", "id")).alias("value"))
    return last.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("config"))
