"""Evidence files: classification, platform and station detection, hashes, manifests and totals."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens.functions.rules import Rule, extension, first_match, split_pair

# File extensions and signatures by kind.
GCS_EXTS = (".plan", ".waypoints", ".wpl", ".kml", ".kmz", ".tlog", ".param", ".params", ".dpml", ".wpml", ".mission", ".mxml")
VIDEO_EXTS = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".ts", ".m2ts", ".3gp")
IMAGE_EXTS = (".jpg", ".jpeg", ".png", ".dng", ".tiff", ".tif", ".bmp", ".webp", ".raw", ".cr2", ".nef", ".arw")

# The names, extensions and signatures in the rules below are fixed values as well.
#: (station|controller) of ground-control files.
STATION_RULES = (
    Rule("Mission Planner / QGroundControl", (".tlog",), also="ArduPilot / PX4"),
    Rule("QGroundControl", (".plan",), also="PX4 / ArduPilot"),
    Rule("QGroundControl / Mission Planner", (".waypoints", ".txt"), r"^[^\n]*QGC WPL", also="ArduPilot / PX4"),
    Rule("DJI Pilot 2 (WPML)", (".kml", ".kmz"), r"wpml:|(?i:dji)", also="DJI"),
    Rule("iNav Mission Planner / mwp", (".mission", ".mwp"), also="Betaflight / iNav"),
    Rule("QGroundControl", (".json",), r'"groundStation": "QGroundControl"|"fileType": "Plan"', also="PX4 / ArduPilot"),
    Rule("DJI GS Pro", (".json",), r"(?i)gs_pro|gs pro|gspro|dji", also="DJI"),
    Rule("Parrot FlightPlan", (".json",), r"(?i)flightplan|freeflight|parrot", also="Parrot"),
    Rule("iNav Mission Planner", (".json",), r"(?i)inav|mwp", also="Betaflight / iNav"),
    Rule("Parrot FlightPlan", (".mavlink",), also="Parrot"),
    Rule("Mission Planner / QGroundControl", (".param", ".parm"), also="ArduPilot"),
)
CATEGORY_RULES = (
    Rule("GCS", GCS_EXTS),
    Rule("GCS", (), r'#QGC WPL|"fileType": "Plan"|"groundStation"|(?i:<kml|<wpml)'),
    *(Rule("GCS", r.exts, r.head) for r in STATION_RULES),
    Rule("VIDEO_IMAGES", VIDEO_EXTS + IMAGE_EXTS),
    Rule("VIDEO_IMAGES", (), "", r"(?:media|photo|video).*\.(?:eo1|e0[^.]*)$"),
    Rule("VIDEO_IMAGES", (), r"(?s)^(?:ÿØÿ|\u0089PNG|.{4}(?:ftyp.{4}|moov|mdat|wide))"),
)
#: Platforms in the order they are tried, then by extension alone.
PLATFORM_RULES = (
    Rule("dji", (".srt",), r"HOME|GPS|ISO|F/"),
    Rule("dji", (".txt", ".csv"), r"OSD\.|CUSTOM\.|DJI|flycState"),
    Rule("dji", (".dat",), r"BUILD_VER|DJI|^Uª|^1234567890"),
    Rule("dji", (".dat",), "", r"dji|fly"),
    Rule("dji", (".kmz", ".kml"), r"wpml:|(?i:dji)"),
    Rule("dji", (".kmz", ".kml"), "", r"dji|wpml"),
    Rule("dji", (".json",), r"gs_pro|home_location|DJI"),
    Rule("ardupilot", (".bin",), r"^£\u0095"),
    Rule("ardupilot", (".log", ".txt"), r"FMT,"),
    Rule("ardupilot", (".tlog",), r"[þý]"),
    Rule("ardupilot", (".waypoints", ".txt"), r"QGC WPL"),
    Rule("ardupilot", (".plan",), r"QGroundControl|Plan"),
    Rule("ardupilot", (".param", ".parm")),
    Rule("ardupilot", (".bin", ".log", ".txt", ".tlog", ".waypoints", ".plan"), "", r"ardupilot|pixhawk|mission_planner|arducopter|arduplane"),
    Rule("px4", (".ulg",), r"ULog"),
    Rule("px4", (".csv",), r"^[^\n]*timestamp[^\n]*(?:lat|vehicle_gps|lon)|^[^\n]*(?:lat|vehicle_gps|lon)[^\n]*timestamp"),
    Rule("px4", (".ulg", ".csv"), "", r"px4|qgroundcontrol|qgc"),
    Rule("parrot", (".json",), r"(?i)parrot|anafi|bebop|run_id|flightplan"),
    Rule("parrot", (".pud", ".mavlink")),
    Rule("betaflight", (".bbl", ".txt", ".log", ".csv"), r"H Product:Blackbox|H Firmware type:(?:Betaflight|INAV)"),
    Rule("betaflight", (".mission", ".mwp")),
    Rule("betaflight", (".xml",), r"(?i)<mission|<waypoint"),
    Rule("betaflight", (".txt",), r"feature GPS|set nav_|set craft_name|# diff"),
    Rule("betaflight", (".bbl", ".txt", ".log", ".csv", ".xml"), "", r"blackbox|betaflight|inav|mwp"),
    Rule("ardupilot", (".bin",)),
    Rule("px4", (".ulg",)),
    Rule("betaflight", (".bbl",)),
)
#: Companion apps by path, then by content.
APP_RULES = (
    Rule("Litchi for DJI Drones", (), "", "litchi", also="DJI"),
    Rule("SpeedyBee Mobile App", (), "", "speedybee", also="Betaflight / iNav"),
    Rule("Parrot FreeFlight 6", (), "", "freeflight|parrot", also="Parrot"),
    Rule("QGroundControl Mobile", (), "", "qgroundcontrol|qgc", also="ArduPilot / PX4"),
    Rule("Autel Explorer", (), "", "autel", also="Autel Robotics"),
    Rule("DJI Fly", (), "", r"dji\.go|djigo|djifly", also="DJI"),
    Rule("Litchi for DJI Drones", (".csv",), r"(?i)^[^\n]*phone_latitude|^(?![^\n]*flyc_state)[^\n]*home_latitude", also="DJI"),
    Rule("Autel Explorer", (".csv",), r"(?i)^[^\n]*(?:autel|flightrecord)", also="Autel Robotics"),
    Rule("SpeedyBee Mobile App", (".diff", ".dump", ".txt"), r"(?is)speedybee|batch start.*diff|diff.*batch start|feature -rx_spi|callsign.*(?:set |profile)|(?:set |profile).*callsign", also="Betaflight / iNav"),
    Rule("Parrot FreeFlight 6", (".json",), r"(?i)freeflight|anafi|bebop|parrot|gutma|flight_logging", also="Parrot"),
)
FOLDERS = {"LOGS": "logs", "VIDEO_IMAGES": "video_images", "GCS": "gcs"}
DISPLAY_NAMES = {"LOGS": "Flight & Mobile Logs", "VIDEO_IMAGES": "Video & Images", "GCS": "Ground Control Station (GCS)"}
#: Names by which a category may be asked for.
CATEGORY_ALIASES = {
    "log": "LOGS", "logs": "LOGS", "video": "VIDEO_IMAGES", "videos": "VIDEO_IMAGES", "image": "VIDEO_IMAGES", "images": "VIDEO_IMAGES",
    "media": "VIDEO_IMAGES", "video_images": "VIDEO_IMAGES", "gcs": "GCS", "gsc": "GCS", "station": "GCS",
}


def head_text(content: Column, size: int = 2048) -> Column:
    """The first bytes as one character each, so that signatures and words are both patterns."""
    return F.decode(F.substring(content, 1, size), "ISO-8859-1")


def classify(path: Column, head: Column) -> Column:
    """LOGS, VIDEO_IMAGES or GCS."""
    return first_match(CATEGORY_RULES, path, head, "LOGS")


def detect_platform(path: Column, head: Column) -> Column:
    """The platform whose reader takes the file; dji where nothing speaks for another."""
    return first_match(PLATFORM_RULES, path, head, "dji")


def ground_station(path: Column, head: Column) -> Column:
    """Struct of station and controller of a ground-control file; nulls for others."""
    return split_pair(first_match(STATION_RULES, path, head), "station", "controller")


def companion_app(path: Column, head: Column) -> Column:
    """Struct of app and platform of a phone's file; nulls for others."""
    return split_pair(first_match(APP_RULES, F.regexp_replace(path, r"[/\\](?=.*\.)", "~"), head), "app_name", "platform")


def media_type(path: Column) -> Column:
    return F.when(extension(path).isin(*VIDEO_EXTS), "VIDEO").otherwise("IMAGE")


def category_folder(category: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), category), F.lit("logs"))


def category_name(category: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv]), category), F.lit("Logs"))


def by_category(evidence: DataFrame, asked: str) -> DataFrame:
    """Evidence of a category named by any of its aliases; all for 'all'."""
    if asked.lower() == "all":
        return evidence
    return evidence.filter(F.col("category") == CATEGORY_ALIASES.get(asked.lower(), asked.upper()))


@F.pandas_udf(T.StringType())
def sha3_256(content: pd.Series) -> pd.Series:
    """SHA3-256 in hex, which Spark has no function for."""
    return content.map(lambda b: None if b is None else hashlib.sha3_256(bytes(b)).hexdigest())


def hash_manifest(items: DataFrame, content: Column, sha3: bool = True) -> DataFrame:
    """items with sha256, md5, byte_count and, if asked for, sha3_256 of a binary column; nulls stay null."""
    found = items.withColumns({"sha256": F.sha2(content, 256), "md5": F.md5(content), "byte_count": F.octet_length(content).cast("long")})
    return found.withColumn("sha3_256", sha3_256(content)) if sha3 else found


def verify_manifest(expected: DataFrame, computed: DataFrame) -> DataFrame:
    """Every item of either manifest with a flag per hash, compared in any case; valid only if all match.

    sha3_256 has a flag, and counts, where both manifests have the column.
    """
    e, c = expected.alias("e"), computed.alias("c")
    joined = e.join(c, F.col("e.item_id") == F.col("c.item_id"), "full_outer")
    flags = {f"{h}_match": F.coalesce(F.lower(f"e.{h}") == F.lower(f"c.{h}"), F.lit(False)) for h in ("sha256", "md5")}
    flags["bytes_match"] = F.coalesce(F.col("e.byte_count") == F.col("c.byte_count"), F.lit(False))
    if "sha3_256" in expected.columns and "sha3_256" in computed.columns:
        flags["sha3_256_match"] = F.coalesce(F.lower("e.sha3_256") == F.lower("c.sha3_256"), F.lit(False))
    found = joined.select(F.coalesce("e.item_id", "c.item_id").alias("item_id"), *[v.alias(k) for k, v in flags.items()])
    return found.withColumn("is_valid", reduce(Column.__and__, [F.col(k) for k in flags]))


def acquisition_totals(files: DataFrame) -> DataFrame:
    """Files and bytes per case."""
    return files.groupBy("case_id").agg(F.count("*").alias("files"), F.sum("byte_count").alias("bytes"))
