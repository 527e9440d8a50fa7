"""The model's tables as views of generic event, document, page and conversation tables.

Each view comes twice: as a DataFrame, and as a SQL subquery for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.functions.geo import EARTH_RADIUS_M
from flightlens.session import table
from flightlens.sources import zones

#: Event types of the generic table and what they stand for.
EVENT_TYPES = {"purchase": "MEDIA_CAPTURE", "click": "WAYPOINT_REACHED", "view": "TAKEOFF", "error": "ERROR_ALERT", "signup": "DISARM"}
#: Rows of a plan that come before this one are its home.
PLAN_HOME = 20


def _coordinate(base: float, factor: int, span: int, scale: float) -> Column:
    return F.lit(base) + (F.col("event_id") * factor % span) / F.lit(scale)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of ten cases; every 97th row's clock is two hours slow."""
    rows = table(spark, sf_dir, "events")
    slow = F.when(F.col("event_id") % 97 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 0 hours"))
    return rows.select(
        (F.col("user_id") % 10).alias("case_id"),
        F.lit(0).cast("long").alias("ingest_seq"),
        F.col("event_id").alias("seq"),
        (F.col("ts").cast("timestamp") - slow).alias("ts"),
        _coordinate(18.85, 7919, 2000, 4000.0).alias("latitude"),
        _coordinate(72.65, 104729, 1999, 4000.0).alias("longitude"),
        F.col("value").alias("altitude_m"),
        ((F.col("event_id") % 200) / F.lit(10.0)).alias("ground_speed_mps"),
        F.get_json_object("props", "$.k").cast("double").alias("battery_pct"),
        F.col("event_type").alias("raw_type"),
    )


TELEMETRY = """tel AS (
  SELECT user_id % 10 AS case_id, event_id AS seq,
         CAST(ts AS TIMESTAMP) - CASE WHEN event_id % 97 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS ts,
         CAST(18.85 AS DOUBLE) + ((event_id * 7919) % 2000) / CAST(4000 AS DOUBLE) AS latitude,
         CAST(72.65 AS DOUBLE) + ((event_id * 104729) % 1999) / CAST(4000 AS DOUBLE) AS longitude,
         value AS altitude_m, (event_id % 200) / CAST(10 AS DOUBLE) AS ground_speed_mps,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS battery_pct, event_type AS raw_type
  FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flight events, one per telemetry row."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), F.col("raw_type"))
    rows = telemetry(spark, sf_dir).withColumn("event_type", F.coalesce(kind, F.lit("UNKNOWN")))
    severity = F.when(F.col("event_type") == "ERROR_ALERT", "WARNING").otherwise("INFO")
    return rows.withColumns({"severity": severity, "description": F.concat(F.lit("event "), F.col("seq").cast("string")), "event_id": F.col("seq")}).drop("raw_type")


EVENTS = (
    TELEMETRY
    + """, ev AS (
  SELECT *, CASE raw_type WHEN 'purchase' THEN 'MEDIA_CAPTURE' WHEN 'click' THEN 'WAYPOINT_REACHED' WHEN 'view' THEN 'TAKEOFF' WHEN 'error' THEN 'ERROR_ALERT' WHEN 'signup' THEN 'DISARM' ELSE 'UNKNOWN' END AS event_type,
         CASE WHEN raw_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS severity, 'event ' || CAST(seq AS VARCHAR) AS description
  FROM tel)"""
)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry without its media rows, which are matched against it."""
    return telemetry(spark, sf_dir).filter("raw_type <> 'purchase'")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media files: every other one a video of 30 seconds."""
    rows = telemetry(spark, sf_dir).filter("raw_type = 'purchase'")
    return rows.select("case_id", F.col("seq").alias("media_id"), "ts", F.when(F.col("seq") % 2 == 0, 30.0).alias("duration_sec"))


MEDIA = (
    TELEMETRY
    + """, trk AS (SELECT * FROM tel WHERE raw_type <> 'purchase'),
med AS (SELECT case_id, seq AS media_id, ts, CASE WHEN seq % 2 = 0 THEN CAST(30 AS DOUBLE) END AS duration_sec FROM tel WHERE raw_type = 'purchase')"""
)


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan per case: the first row of each day, shifted a little north; the first of all is home."""
    row = F.struct("seq", "latitude", "longitude", "altitude_m")
    days = telemetry(spark, sf_dir).groupBy("case_id", F.to_date("ts").alias("day")).agg(F.min_by(row, "seq").alias("r"))
    return days.select(
        "case_id", F.lit("plan").alias("plan_id"), F.col("r.seq").alias("idx"), F.when(F.col("r.seq") < PLAN_HOME, "HOME").otherwise("WAYPOINT").alias("command"),
        (F.col("r.latitude") + F.lit(0.0002)).alias("latitude"), F.col("r.longitude").alias("longitude"), F.col("r.altitude_m").alias("altitude_m"),
    )


WAYPOINTS = (
    TELEMETRY
    + f""", dy AS (SELECT case_id, CAST(ts AS DATE) AS day, min(seq) AS seq FROM tel GROUP BY 1, 2),
wp AS (
  SELECT tel.case_id, 'plan' AS plan_id, seq AS idx, CASE WHEN seq < {PLAN_HOME} THEN 'HOME' ELSE 'WAYPOINT' END AS command, latitude + CAST(0.0002 AS DOUBLE) AS latitude, longitude, altitude_m
  FROM tel JOIN dy USING (seq))"""
)


def custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custody entries of conversations."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("entry_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("ts_raw"), F.col("role").alias("actor"), F.lit("NOTE").alias("action"), F.col("text").alias("details"),
        F.lit(None).cast("string").alias("evidence_item_id"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence files: documents as logs, plans or tables by id, pages by their url."""
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 10).alias("case_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item_id"),
        F.concat(F.lit("in/d"), F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in FILE_EXTS]), (F.col("doc_id") % len(FILE_EXTS) + 1).cast("int"))).alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"),
    )
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 10).alias("case_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("item_id"), F.concat(F.lit("in/page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"),
    )
    return docs.unionByName(pages)


#: Extensions dealt to documents by id.
FILE_EXTS = (".txt", ".plan", ".mp4", ".srt", ".bin", ".jpg", ".ulg", ".kml", ".csv", ".json")
EVIDENCE = (
    """evi AS (
  SELECT doc_id % 10 AS case_id, 'd' || CAST(doc_id AS VARCHAR) AS item_id, 'in/d' || CAST(doc_id AS VARCHAR) || (["""
    + ", ".join(f"'{x}'" for x in FILE_EXTS)
    + """])[doc_id % 10 + 1] AS path, coalesce(text, '') AS content FROM documents
  UNION ALL SELECT page_id % 10, 'p' || CAST(page_id AS VARCHAR), 'in/page' || CAST(page_id AS VARCHAR) || '.html', coalesce(html, '') FROM pages)"""
)


def zone_sql() -> str:
    """The built-in zones as two subqueries: zn, a row per zone, and edge, a row per polygon edge."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    rows = ", ".join("(" + ", ".join(text(r[i]) for i in (0, 1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 14, 15, 16)) + ")" for r in zones.preset_rows())
    ring = zones.BUFFER_RING
    edges = ", ".join(f"('{zones.BUFFER[0]}', {p[0]}, {p[1]}, {q[0]}, {q[1]})" for p, q in zip(ring, [*ring[1:], ring[0]], strict=True))
    return (
        f"zn(zone_pos, zone_id, zone_name, zone_type, clat, clon, radius, ceiling, nofly, category, zone_class, authority, city_region, zone_text) AS (SELECT col0, col1, col2, col3, CAST(col4 AS DOUBLE), CAST(col5 AS DOUBLE), CAST(col6 AS DOUBLE), CAST(col7 AS DOUBLE), col8, col9, col10, col11, col12, col13 FROM (VALUES {rows}) v), "
        f"edge(zone_id, la, lo, lb, lp) AS (SELECT col0, CAST(col1 AS DOUBLE), CAST(col2 AS DOUBLE), CAST(col3 AS DOUBLE), CAST(col4 AS DOUBLE) FROM (VALUES {edges}) v)"
    )


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half = lambda a, b: f"sin((radians({b}) - radians({a})) / 2)"
    a = f"(pow({half(lat1, lat2)}, 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow({half(lon1, lon2)}, 2))"
    return f"({2 * EARTH_RADIUS_M} * atan2(sqrt{a}, sqrt(greatest(0, 1 - {a}))))"


def matches_sql() -> str:
    """Subquery mat: telemetry rows with each zone they are inside of."""
    circle = haversine_sql("t.latitude", "t.longitude", "z.clat", "z.clon")
    return f"""{zone_sql()}, mat AS (
  SELECT t.*, z.* FROM tel t JOIN zn z ON z.zone_type = 'circle' AND {circle} <= z.radius
  UNION ALL
  SELECT t.*, z.* FROM tel t JOIN zn z ON z.zone_type = 'polygon' AND (
    SELECT count(*) FROM edge e WHERE e.zone_id = z.zone_id AND ((e.lo > t.longitude) <> (e.lp > t.longitude))
      AND t.latitude < (e.la - e.lb) * (t.longitude - e.lp) / (e.lo - e.lp + CAST(1e-12 AS DOUBLE)) + e.lb) % 2 = 1)"""
