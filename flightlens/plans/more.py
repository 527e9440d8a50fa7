"""Queries of jobs, streams, single functions and table writes, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.functions import geo
from flightlens.operators import asof, custody, evidence, export, geofence, lifecycle, mission, mobile, retrieval, sinks, summary
from flightlens.operators import jobs as case_jobs
from flightlens.operators.places import by_number, numbered
from flightlens.plans import catalog, files, views
from flightlens.plans.catalog import EXAMPLE_KEY, GAP_SECONDS, JUMP_MPS, query
from flightlens.session import shared_dir, table
from flightlens.sources import lines, missions, registry, zones
from flightlens.streaming import jobs

_TEL, _EV = f"WITH {views.TELEMETRY}", f"WITH {views.EVENTS}"
_MAT = f"{_TEL}, {views.matches_sql()}"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/queries/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- functions and filters


@query("scaled_positions", _TEL + " SELECT seq, CASE WHEN seq % 2 = 0 THEN latitude ELSE round(latitude * 1e7) / 1e7 END AS latitude, CASE WHEN seq % 3 = 0 THEN (seq + 10001) / 1000.0 ELSE CAST(seq % 100 AS DOUBLE) END AS altitude_m FROM tel")
def scaled_positions(spark, sf_dir):
    raw = F.when(F.col("seq") % 2 == 0, F.col("latitude")).otherwise(F.round(F.col("latitude") * 1e7))
    height = F.when(F.col("seq") % 3 == 0, F.col("seq") + 10001).otherwise(F.col("seq") % 100).cast("double")
    return views.telemetry(spark, sf_dir).select("seq", geo.scaled_degrees(raw, 90).alias("latitude"), geo.scaled_metres(height).alias("altitude_m"))


@query("off_null_island", _TEL + " SELECT case_id, count(*) AS kept FROM tel WHERE seq % 5 <> 0 AND (abs(latitude * (seq % 3)) > 0.001 OR abs(longitude * (seq % 2)) > 0.001) GROUP BY case_id")
def off_null_island(spark, sf_dir):
    lat, lon = F.when(F.col("seq") % 5 != 0, F.col("latitude") * (F.col("seq") % 3)), F.col("longitude") * (F.col("seq") % 2)
    return views.telemetry(spark, sf_dir).filter(geo.off_null_island(lat, lon, 0.001)).groupBy("case_id").agg(F.count("*").alias("kept"))


@query("parsed_times", _TEL + " SELECT seq, CASE WHEN seq % 5 <> 4 THEN date_trunc('second', ts) END AS ts FROM tel")
def parsed_times(spark, sf_dir):
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
    raw = F.element_at(F.array(*[F.date_format("ts", f) for f in forms], F.lit("no time")), (F.col("seq") % 5 + 1).cast("int"))
    return views.telemetry(spark, sf_dir).select("seq", lines.parse_ts(raw).alias("ts"))


@query("dms_positions", _TEL + " SELECT seq, CASE WHEN seq % 2 = 0 THEN -1 ELSE 1 END * round(1 + seq % 90 + (seq % 60) / 60.0 + (seq % 59) / 3600.0, 7) AS latitude FROM tel")
def dms_positions(spark, sf_dir):
    part = lambda n: (F.col("seq") % n).cast("double")
    return views.telemetry(spark, sf_dir).select("seq", geo.dms_to_decimal(part(90) + 1, part(60), part(59), F.when(F.col("seq") % 2 == 0, " s").otherwise("N")).alias("latitude"))


@query(
    "mission_commands",
    _TEL + " SELECT seq % 30 AS code, CASE seq % 30 WHEN 16 THEN 'WAYPOINT' WHEN 17 THEN 'LOITER_UNLIM' WHEN 18 THEN 'LOITER_TURNS' WHEN 19 THEN 'LOITER_TIME' WHEN 20 THEN 'RETURN_TO_LAUNCH' WHEN 21 THEN 'LAND' WHEN 22 THEN 'TAKEOFF' ELSE 'MAV_CMD_' || seq % 30 END AS command, count(*) AS n FROM tel GROUP BY ALL",
)
def mission_commands(spark, sf_dir):
    code = F.col("seq") % 30
    return views.telemetry(spark, sf_dir).groupBy(code.alias("code"), missions.command_name(code).alias("command")).agg(F.count("*").alias("n"))


_CATEGORIES = catalog.ORACLE_SQL["classify_evidence"]


@query("category_names", f"WITH c AS ({_CATEGORIES}) SELECT item_id, CASE category WHEN 'VIDEO_IMAGES' THEN 'Video & Images' WHEN 'GCS' THEN 'Ground Control Station (GCS)' ELSE 'Flight & Mobile Logs' END AS name FROM c")
def category_names(spark, sf_dir):
    return catalog.QUERIES["classify_evidence"](spark, sf_dir).select("item_id", evidence.category_name(F.col("category")).alias("name"))


@query("evidence_by_alias", f"WITH c AS ({_CATEGORIES}) SELECT category, count(*) AS items FROM c WHERE category IN ('LOGS', 'VIDEO_IMAGES') GROUP BY category")
def evidence_by_alias(spark, sf_dir):
    found = catalog.QUERIES["classify_evidence"](spark, sf_dir)
    return evidence.by_category(found, "log").unionByName(evidence.by_category(found, "video")).groupBy("category").agg(F.count("*").alias("items"))


@query("media_kinds", f"WITH {views.EVIDENCE} SELECT item_id, CASE WHEN path LIKE '%.mp4' THEN 'VIDEO' ELSE 'IMAGE' END AS kind FROM evi WHERE path LIKE '%.mp4' OR path LIKE '%.jpg'")
def media_kinds(spark, sf_dir):
    return views.evidence(spark, sf_dir).filter(F.col("path").rlike(r"\.(mp4|jpg)$")).select("item_id", evidence.media_type(F.col("path")).alias("kind"))


@query(
    "media_times",
    _TEL + """ SELECT seq, CASE WHEN seq % 4 < 3 OR seq % 8 = 3 THEN date_trunc('second', ts) + to_hours(CAST(CASE seq % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS BIGINT)) END AS ts,
  CASE seq % 4 WHEN 0 THEN 'CONTAINER' WHEN 1 THEN 'TAG' WHEN 2 THEN 'CLIENT' ELSE CASE WHEN seq % 8 = 3 THEN 'FILE' END END AS timestamp_source FROM tel""",
)
def media_times(spark, sf_dir):
    at, k = F.date_trunc("second", "ts"), F.col("seq") % 4
    later = lambda hours: at + F.expr(f"interval {hours} hours")
    rows = views.telemetry(spark, sf_dir).select(
        "seq", F.when(k == 0, later(3)).alias("container_ts"), F.when(k <= 1, F.date_format(later(2), "yyyy:MM:dd HH:mm:ss")).otherwise("none").alias("tag_date"),
        F.when(k <= 2, F.date_format(later(1), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("client_ts"), F.when(F.col("seq") % 8 != 7, at).alias("modified_ts"),
    )
    return case_jobs.media_timestamp(rows).select("seq", "ts", "timestamp_source")


@query("zones_found", _MAT + " SELECT zone_id, count(*) AS points FROM mat WHERE contains(lower(zone_id || ' ' || zone_name || ' ' || category || ' ' || coalesce(authority, '') || ' ' || city_region || ' ' || zone_text), 'coastal') GROUP BY zone_id")
def zones_found(spark, sf_dir):
    wanted = zones.search_zones(zones.zone_catalog(spark), "COASTal")
    return geofence.zone_matches(views.telemetry(spark, sf_dir), wanted).groupBy("zone_id").agg(F.count("*").alias("points"))


@query("zone_by_id", _MAT + f" SELECT case_id, count(*) AS points FROM mat WHERE zone_id = '{zones.BUFFER[0]}' GROUP BY case_id")
def zone_by_id(spark, sf_dir):
    return geofence.zone_matches(views.telemetry(spark, sf_dir), zones.zone_by_id(zones.zone_catalog(spark), zones.BUFFER[0])).groupBy("case_id").agg(F.count("*").alias("points"))


_DEFAULTS = ", ".join(f"'{z}'" for z in zones.DEFAULT_IDS)


@query("zones_loaded", _MAT + f" SELECT zone_id, zone_id NOT IN ({_DEFAULTS}) AS added, count(*) AS points FROM mat GROUP BY zone_id")
def zones_loaded(spark, sf_dir):
    known = zones.zone_catalog(spark)
    loaded = zones.load_all(known.filter(F.col("zone_id").isin(*zones.DEFAULT_IDS)), known)
    return geofence.zone_matches(views.telemetry(spark, sf_dir), loaded).groupBy("zone_id", "added").agg(F.count("*").alias("points"))


# ---------------------------------------------------------------- joins, lifecycle, missions, apps


@query(
    "file_anchors",
    _EV + """, a AS (SELECT case_id, seq // 1000 AS file, min(seq) AS f, max(seq) AS l FROM tel GROUP BY 1, 2)
SELECT e.case_id, e.seq, e.event_type, t.latitude, t.longitude, t.altitude_m FROM ev e JOIN a ON a.case_id = e.case_id AND a.file = e.seq // 1000 JOIN tel t ON t.seq = CASE WHEN e.event_type = 'DISARM' THEN a.l ELSE a.f END""",
)
def file_anchors(spark, sf_dir):
    of_file = lambda df: df.withColumn("evidence_id", F.floor(F.col("seq") / 1000))
    ev = of_file(views.events(spark, sf_dir)).select("case_id", "evidence_id", "seq", "event_type")
    return lifecycle.file_anchors(ev, of_file(views.telemetry(spark, sf_dir))).drop("evidence_id")


@query(
    "boot_times",
    _TEL + """, r AS (SELECT case_id, seq, seq * 250 AS boot_ms, CASE WHEN seq % 3 = 1 THEN ts END AS gps FROM tel),
o AS (SELECT case_id, arg_min(epoch_us(gps) - boot_ms * 1000, seq) AS us FROM r WHERE gps IS NOT NULL GROUP BY case_id)
SELECT case_id, seq, make_timestamp(us + boot_ms * 1000) AS ts FROM r LEFT JOIN o USING (case_id)""",
)
def boot_times(spark, sf_dir):
    rows = views.telemetry(spark, sf_dir).select(F.col("case_id").alias("evidence_id"), "seq", (F.col("seq") * 250).alias("boot_ms"), F.when(F.col("seq") % 3 == 1, F.col("ts")).alias("gps_ts"))
    return lifecycle.boot_time(rows).select(F.col("evidence_id").alias("case_id"), "seq", "ts")


@query(
    "last_position_of_events",
    f"""{_EV} SELECT e.case_id, e.seq AS event_id, e.event_type, arg_max(t.latitude, struct_pack(ts := t.ts, seq := t.seq)) AS latitude, arg_max(t.longitude, struct_pack(ts := t.ts, seq := t.seq)) AS longitude
FROM ev e LEFT JOIN tel t ON t.case_id = e.case_id AND t.ts <= e.ts AND t.raw_type <> 'purchase' GROUP BY e.case_id, e.seq, e.event_type""",
)
def last_position_of_events(spark, sf_dir):
    """Every event of the table against the whole track."""
    return asof.last_known_position(views.events(spark, sf_dir), views.track(spark, sf_dir)).select("case_id", "event_id", "event_type", "latitude", "longitude")


@query("waypoint_telemetry", f"WITH {views.WAYPOINTS} SELECT case_id, idx AS seq, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(idx * 15) AS ts, latitude, longitude, altitude_m, 'PLANNED' AS source_channel FROM wp")
def waypoint_telemetry(spark, sf_dir):
    return mission.waypoint_telemetry(views.waypoints(spark, sf_dir), "2024-01-01 00:00:00").drop("plan_id")


@query("gcs_overview", f"WITH {views.WAYPOINTS} SELECT case_id, count(DISTINCT plan_id) AS plans, string_agg(DISTINCT command, ',' ORDER BY command) AS commands FROM wp GROUP BY case_id")
def gcs_overview(spark, sf_dir):
    return mission.overview(views.waypoints(spark, sf_dir)).withColumn("commands", F.array_join("commands", ","))


_KINDS = "list_extract(['LOG', 'PLAN', 'MEDIA', 'HARDWARE'], CAST(event_id % 4 + 1 AS INTEGER))"


def _app_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("LOG", "PLAN", "MEDIA", "HARDWARE")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("case_id"), F.col("event_type").alias("app_name"), kind.alias("kind"), F.concat(F.lit("n"), (F.col("event_id") % 9).cast("string")).alias("name"), F.lit("v").alias("value"), (F.col("event_id") % 5).alias("points")
    )


@query(
    "mobile_artifacts",
    f"""WITH f AS (SELECT user_id % 10 AS case_id, event_type AS app_name, {_KINDS} AS kind, 'n' || event_id % 9 AS name, event_id % 5 AS points FROM events)
SELECT case_id, app_name, coalesce(string_agg(DISTINCT CASE WHEN kind = 'LOG' THEN name END, ',' ORDER BY CASE WHEN kind = 'LOG' THEN name END), '') AS logs, coalesce(string_agg(DISTINCT CASE WHEN kind = 'PLAN' THEN name END, ',' ORDER BY CASE WHEN kind = 'PLAN' THEN name END), '') AS plans,
  count(DISTINCT CASE WHEN kind = 'HARDWARE' THEN name END) AS hardware, CAST(sum(points) AS BIGINT) AS points, count(*) AS files FROM f GROUP BY case_id, app_name""",
)
def mobile_artifacts(spark, sf_dir):
    found = mobile.mobile_artifacts(_app_files(spark, sf_dir))
    return found.select("case_id", "app_name", F.array_join("logs", ",").alias("logs"), F.array_join("plans", ",").alias("plans"), F.size("hardware").cast("long").alias("hardware"), "points", "files")


@query("merged_artifacts", "WITH a AS (SELECT DISTINCT user_id % 10 AS case_id, event_type AS app_name FROM events) SELECT case_id, app_name, CASE WHEN case_id % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM a")
def merged_artifacts(spark, sf_dir):
    apps = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("case_id"), F.col("event_type").alias("app_name")).distinct()
    return mobile.merge_artifacts(apps.filter("case_id % 2 = 0").withColumn("origin", F.lit("old")), apps.withColumn("origin", F.lit("new")))


@query(
    "app_catalog",
    "SELECT DISTINCT user_id % 10 AS case_id, event_type AS app_name, CASE event_type WHEN 'click' THEN 'a.b' WHEN 'view' THEN 'a.c' END AS package_id, CASE WHEN event_type IN ('click', 'view') THEN 'P1' ELSE 'Generic Mobile' END AS platform FROM events",
)
def app_catalog(spark, sf_dir):
    apps = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("case_id"), F.col("event_type").alias("app_name")).distinct()
    known = spark.createDataFrame([("Click", "a.b", "P1"), ("VIEW", "a.c", "P1")], "app_name string, package_id string, platform string")
    return mobile.with_app_catalog(apps, known)


# ---------------------------------------------------------------- chunks


@query(
    "chunk_windows",
    f"""WITH w AS ({catalog.ORACLE_SQL["telemetry_windows"]}) SELECT case_id, win, samples, '[TELEMETRY_WINDOW] Time: ' || strftime(start_ts, '%Y-%m-%dT%H:%M:%SZ') || ' to ' || strftime(end_ts, '%Y-%m-%dT%H:%M:%SZ') || ' (' || samples || ' samples) | Altitude Range: ' AS head FROM w""",
)
def chunk_windows(spark, sf_dir):
    windows = summary.telemetry_windows(views.telemetry(spark, sf_dir))
    found = retrieval.chunk_windows(windows)
    return found.select("case_id", F.col("place").alias("win"), F.col("metadata")["samples_count"].cast("long").alias("samples"), F.concat(F.split_part("text", F.lit("Range: "), F.lit(1)), F.lit("Range: ")).alias("head"))


@query(
    "chunk_violations",
    _MAT + f""" SELECT case_id || '_geofence_violation_' || (seq * 1000 + zone_pos) AS chunk_id, '[GEOFENCE_VIOLATION] Zone: ''' || zone_name || ''' (ID: ' || zone_id || ') | Breach Type: ' || CASE WHEN {catalog._OVER} THEN 'CEILING_EXCEEDED' ELSE 'BOUNDARY_ENTRY' END
  || ' | Severity: ' || CASE WHEN nofly OR zone_class = 'RED' THEN 'CRITICAL' ELSE 'WARNING' END || ' | Timestamp (UTC): ' || {catalog._STAMP} || ' | Breach Coordinates: ' || printf('lat=%.6f, lon=%.6f, alt=%.1fm', latitude, longitude, altitude_m)
  || ' | Jurisdiction Authority: ' || coalesce(authority, 'DGCA / Local Civil Aviation') || ' | Airspace Category: ' || coalesce(category, 'RESTRICTED') AS head FROM mat""",
)
def chunk_violations(spark, sf_dir):
    found = retrieval.all_chunks(retrieval.chunk_violations(geofence.geofence_violations(views.telemetry(spark, sf_dir), zones.zone_catalog(spark))))
    return found.select("chunk_id", F.split_part("text", F.lit(" | Details: "), F.lit(1)).alias("head"))


@query(
    "chunk_evidence",
    f"""WITH c AS ({_CATEGORIES}), {views.EVIDENCE} SELECT item_id, '[EVIDENCE_ITEM] File: ' || evi.path || ' (Item ID: ' || item_id || ') | Platform: UNKNOWN | Category: ' || c.category || ' | Size: ' || strlen(content) || ' bytes | SHA-256: ' || sha256(content) AS text FROM evi JOIN c USING (item_id)""",
)
def chunk_evidence(spark, sf_dir):
    kinds = catalog.QUERIES["classify_evidence"](spark, sf_dir).select("item_id", "category")
    items = evidence.hash_manifest(views.evidence(spark, sf_dir), F.col("content"), sha3=False).join(kinds, "item_id").withColumn("platform", F.lit(None).cast("string"))
    return retrieval.chunk_evidence(items).select(F.col("metadata")["item_id"].alias("item_id"), "text")


@query(
    "chunk_plans",
    f"WITH p AS ({catalog.ORACLE_SQL['plan_metrics']}) SELECT case_id, '[MISSION_PLAN] Plan ID: plan | Target GCS: QGC | Waypoints Count: ' || waypoints || ' | Total Planned Distance: ' || printf('%.1f', planned_distance_m) || 'm | Max Altitude: ' || printf('%.1f', planned_max_altitude_m) || 'm' AS text FROM p",
)
def chunk_plans(spark, sf_dir):
    plans = mission.plan_metrics(views.waypoints(spark, sf_dir)).withColumn("gcs_name", F.lit("QGC"))
    return retrieval.chunk_plans(plans).select("case_id", "text")


@query(
    "chunk_stations",
    f"WITH {views.WAYPOINTS}, o AS (SELECT case_id, count(DISTINCT plan_id) AS plans, count(DISTINCT command) AS commands FROM wp GROUP BY case_id) SELECT case_id, '[GCS_ANALYSIS] Mission Plans: ' || plans || ' | Commands Issued: ' || commands AS text FROM o",
)
def chunk_stations(spark, sf_dir):
    return retrieval.chunk_stations(mission.overview(views.waypoints(spark, sf_dir))).select("case_id", "text")


# ---------------------------------------------------------------- jobs and writes


@query("custody_audit", "SELECT conv_id AS case_id, turn AS entry_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role AS actor FROM conversations")
def custody_audit(spark, sf_dir):
    signed = custody.chain_append(views.custody(spark, sf_dir), EXAMPLE_KEY)
    genuine = custody.chain_check(signed, EXAMPLE_KEY).filter("linked and genuine")
    return numbered(genuine, "place", ["case_id"], {"_stretch": by_number(F.col("entry_id"))}, ["entry_id"]).select("case_id", "entry_id", "place", "actor")


@query(
    "ingested_index",
    _EV + " SELECT case_id, count(*) AS chunks, true AS ready, CAST(768 AS BIGINT) AS dims, CAST(1 AS DOUBLE) AS length FROM ev GROUP BY case_id",
)
def ingested_index(spark, sf_dir):
    path = _folder(spark)
    for _ in range(2):  # a repeated ingest replaces
        case_jobs.ingest_case([retrieval.chunk_events(views.events(spark, sf_dir))], path)
    index = spark.read.parquet(path)
    sizes = index.groupBy("case_id").agg(F.min(F.size("embedding")).cast("long").alias("dims"), F.round(F.min(retrieval.length(F.col("embedding"))), 4).alias("length"))
    return retrieval.chunk_count(index).join(sizes, "case_id").withColumn("case_id", F.col("case_id").cast("long"))


@query("retrieved_context", _EV + " SELECT e.case_id, '[1] [FLIGHT_EVENT]' AS head, least(count(*), 10) AS sources FROM ev e GROUP BY e.case_id")
def retrieved_context(spark, sf_dir):
    path = _folder(spark)
    case_jobs.ingest_case([retrieval.chunk_events(views.events(spark, sf_dir))], path)
    questions = views.telemetry(spark, sf_dir).select("case_id").distinct().select(F.col("case_id").alias("query_id"), "case_id", F.lit("which alerts were raised").alias("text"))
    found = case_jobs.retrieve(spark, path, questions)
    return found.select(F.col("query_id").alias("case_id"), F.substring("context", 1, 18).alias("head"), F.size(F.split("context", "\n")).cast("long").alias("sources"))


@query(
    "case_report",
    f"""WITH v AS ({catalog.ORACLE_SQL['geofence_violations']}), s AS ({catalog.ORACLE_SQL['flight_summary']}), e AS ({catalog.ORACLE_SQL['breach_episodes']})
SELECT s.case_id, (SELECT count(*) FROM v WHERE v.case_id = s.case_id) AS violations, (SELECT count(*) FROM e WHERE e.case_id = s.case_id) AS episodes FROM s""",
)
def case_report(spark, sf_dir):
    analysis = case_jobs.analyze(views.telemetry(spark, sf_dir), views.events(spark, sf_dir), zones.zone_catalog(spark))
    path = _folder(spark)
    case_jobs.write_case_report(analysis, path, views.waypoints(spark, sf_dir), "gzip")
    counts = export.read_rows(spark, path, lambda row: F.lit(True)).groupBy("case_id").agg(*[F.count_if(F.col("array") == n).alias(n) for n in ("violations", "episodes")])
    cases = analysis["summary"].select(F.col("case_id").cast("long").alias("case_id"))
    return cases.join(counts, "case_id", "left").select("case_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("violations", "episodes")])


@query("saved_and_restored", _TEL + " SELECT case_id, count(*) AS points FROM tel WHERE case_id <> 3 GROUP BY case_id")
def saved_and_restored(spark, sf_dir):
    path = _folder(spark)
    case_jobs.save({"telemetry": views.telemetry(spark, sf_dir)}, path)
    found = case_jobs.restore(spark, path, ["telemetry"])["telemetry"]
    gone = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("case_id")).filter("case_id = 3").distinct()
    return sinks.delete_cases(found, gone).groupBy(F.col("case_id").cast("long").alias("case_id")).agg(F.count("*").alias("points"))


@query("written_by_category", f"WITH c AS ({_CATEGORIES}), {views.EVIDENCE} SELECT evi.case_id, c.category, count(*) AS items FROM c JOIN evi USING (item_id) GROUP BY evi.case_id, c.category")
def written_by_category(spark, sf_dir):
    path = _folder(spark)
    kinds = catalog.QUERIES["classify_evidence"](spark, sf_dir).select("item_id", "category")
    sinks.write_by_category(views.evidence(spark, sf_dir).select("case_id", "item_id").join(kinds, "item_id"), path)
    return spark.read.parquet(path).groupBy(F.col("case_id").cast("long").alias("case_id"), "category").agg(F.count("*").alias("items"))


@query(
    "dfxml_objects",
    f"WITH {views.EVIDENCE} SELECT case_id, item_id, '<fileobject><filename>' || path || '</filename><filesize>' || strlen(content) || '</filesize><hashdigest type=''md5''>' || md5(content) || '</hashdigest><hashdigest type=''sha256''>' || sha256(content) || '</hashdigest></fileobject>' AS xml FROM evi",
)
def dfxml_objects(spark, sf_dir):
    return sinks.to_dfxml(evidence.hash_manifest(views.evidence(spark, sf_dir), F.col("content"), sha3=False))


@query("kml_files", f"WITH k AS ({catalog.ORACLE_SQL['kml_track']}) SELECT case_id, sha256(kml || chr(10)) AS sha256 FROM k")
def kml_files(spark, sf_dir):
    path = _folder(spark)
    sinks.write_kml(views.telemetry(spark, sf_dir), path)
    return files.of_case(lines.read_whole(spark, path)).select("case_id", F.sha2("text", 256).alias("sha256"))


@query("geojson_files", f"WITH k AS ({catalog.ORACLE_SQL['geojson_track']}) SELECT case_id, sha256(geojson) AS sha256 FROM k")
def geojson_files(spark, sf_dir):
    path = _folder(spark)
    sinks.write_geojson(views.telemetry(spark, sf_dir), path)
    return files.of_case(lines.read_whole(spark, path)).select("case_id", F.sha2(F.replace("text", F.lit("\n"), F.lit("")), 256).alias("sha256"))


@query("appended_case", _TEL + " SELECT CAST(77 AS BIGINT) AS case_id, case_id AS ingest_seq, count(*) AS points FROM tel WHERE case_id < 4 GROUP BY tel.case_id")
def appended_case(spark, sf_dir):
    rows = views.telemetry(spark, sf_dir).withColumn("file", F.col("case_id").cast("string")).drop("case_id", "ingest_seq")
    order = views.telemetry(spark, sf_dir).filter("case_id < 4").select(F.col("case_id").cast("string").alias("file"), F.col("case_id").alias("ingest_seq")).distinct()
    return registry.append_case(rows, 77, order).groupBy(F.col("case_id").cast("long").alias("case_id"), "ingest_seq").agg(F.count("*").alias("points"))


# ---------------------------------------------------------------- streams


@query("stream_gaps", catalog._NEIGHBOURS + " SELECT case_id, seq, anomaly_type, ts FROM found WHERE check_no < 3")
def stream_gaps(spark, sf_dir):
    return jobs.run_gaps(spark, sf_dir, GAP_SECONDS, JUMP_MPS).select("case_id", "seq", "anomaly_type", "ts")


@query("stream_windows", _TEL + " SELECT case_id, date_trunc('hour', ts) AS start_ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_ts, count(*) AS samples, max(altitude_m) AS max_altitude_m FROM tel GROUP BY ALL")
def stream_windows(spark, sf_dir):
    return jobs.run_windows(spark, sf_dir, "1 hour", "1 hour").drop("avg_speed_mps")


@query(
    "stream_flights",
    _TEL + """, g AS (SELECT case_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM tel WINDOW w AS (PARTITION BY case_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY case_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT case_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS points FROM s GROUP BY case_id, k""",
)
def stream_flights(spark, sf_dir):
    return jobs.run_flights(spark, sf_dir, "30 minutes")


@query(
    "stream_media_match",
    f"""WITH {views.MEDIA} SELECT m.case_id, m.media_id, t.seq FROM med m JOIN trk t ON t.case_id = m.case_id AND epoch_us(t.ts) - epoch_us(m.ts) BETWEEN
  CASE WHEN coalesce(duration_sec, 0) > 0 THEN -15000000 ELSE -600000000 END AND CASE WHEN coalesce(duration_sec, 0) > 0 THEN 45000000 ELSE 600000000 END""",
)
def stream_media_match(spark, sf_dir):
    return jobs.run_media_match(spark, sf_dir, 600).select("case_id", "media_id", "seq")
