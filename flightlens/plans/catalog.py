"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.operators import anomalies, asof, custody, detectors, evidence, geofence, lifecycle, mission, mobile, retrieval, sinks, summary, timeline
from flightlens.plans import views
from flightlens.session import table
from flightlens.sources import zones
from flightlens.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Key of the registered custody queries; a deployment passes its own to the operators.
EXAMPLE_KEY = b"example key of the test data"
#: Thresholds that fit the test data, whose neighbours lie about an hour apart.
GAP_SECONDS, JUMP_MPS = 3600.0, 5.0


def plain(df: DataFrame) -> DataFrame:
    """df with integers as longs and timestamps without a zone, as the oracles have them."""
    kinds = {"int": "long", "smallint": "long", "timestamp": "timestamp_ntz", "float": "double"}
    return df.select(*[F.col(c).cast(kinds[t]).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) and its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- geofences

_OVER = "coalesce(altitude_m > ceiling, false)"
_PREFIX = "CASE WHEN coalesce(authority, '') <> '' THEN ' [' || authority || ']' ELSE '' END"


@query(
    "geofence_violations",
    f"""WITH {views.TELEMETRY}, {views.matches_sql()}
SELECT case_id, printf('VIO-%04d', row_number() OVER (PARTITION BY case_id ORDER BY seq, zone_pos)) AS violation_id, seq, zone_id, zone_name, ts,
       CASE WHEN {_OVER} THEN 'CEILING_EXCEEDED' ELSE 'BOUNDARY_ENTRY' END AS violation_type,
       CASE WHEN nofly OR zone_class = 'RED' THEN 'CRITICAL' ELSE 'WARNING' END AS severity, category, authority
FROM mat""",
)
def geofence_violations(spark, sf_dir):
    found = geofence.geofence_violations(views.telemetry(spark, sf_dir), zones.zone_catalog(spark))
    return found.select("case_id", "violation_id", "seq", "zone_id", "zone_name", "ts", "violation_type", "severity", "category", "authority")


@query(
    "breach_details",
    f"""WITH {views.TELEMETRY}, {views.matches_sql()}
SELECT case_id, seq, zone_id, CASE WHEN {_OVER}
  THEN 'UAV exceeded statutory ceiling (' || CAST(ceiling AS VARCHAR) || 'm) inside ''' || zone_name || '''' || {_PREFIX} || ' at altitude ' || printf('%.1f', altitude_m) || 'm'
  ELSE 'UAV entered restricted airspace ''' || zone_name || '''' || {_PREFIX} || ' at altitude ' || printf('%.1f', altitude_m) || 'm' END AS details
FROM mat""",
)
def breach_details(spark, sf_dir):
    return geofence.geofence_violations(views.telemetry(spark, sf_dir), zones.zone_catalog(spark)).select("case_id", "seq", "zone_id", "details")


@query(
    "geofence_by_zone",
    f"""WITH {views.TELEMETRY}, {views.matches_sql()}
SELECT zone_id, count(*) AS points, count(DISTINCT case_id) AS cases, max(altitude_m) AS max_altitude_m FROM mat WHERE category IN ('AIRPORT', 'AIRDROME') GROUP BY zone_id""",
)
def geofence_by_zone(spark, sf_dir):
    catalog = zones.zone_catalog(spark)
    wanted = zones.filter_zones(catalog, "AIRPORT", zones.REGION).unionByName(zones.filter_zones(catalog, "AIRDROME", "ALL"))
    found = geofence.zone_matches(views.telemetry(spark, sf_dir), wanted)
    return found.groupBy("zone_id").agg(F.count("*").alias("points"), F.count_distinct("case_id").alias("cases"), F.max("altitude_m").alias("max_altitude_m"))


@query(
    "geofence_after_upsert",
    f"""WITH {views.TELEMETRY}, {views.matches_sql()}
SELECT zone_id, count(*) AS points, CAST(count_if(altitude_m > 30) AS BIGINT) AS over_30 FROM mat WHERE zone_id IN ('ZONE-BUFFER-IITB', 'ZONE-AIRPORT-BOM') GROUP BY zone_id""",
)
def geofence_after_upsert(spark, sf_dir):
    catalog = zones.zone_catalog(spark)
    start = catalog.filter(F.col("zone_id").isin(*zones.DEFAULT_IDS))
    imported = zones.import_zones(start, catalog, [zones.BUFFER[0]])
    lowered = zones.upsert_zones(imported, zones.zone_by_id(catalog, zones.BUFFER[0]).withColumn("max_altitude_m", F.lit(30.0)))
    found = geofence.geofence_violations(views.telemetry(spark, sf_dir), lowered)
    return found.groupBy("zone_id").agg(F.count("*").alias("points"), F.count_if(F.col("altitude_m") > 30).alias("over_30"))


@query(
    "breach_episodes",
    f"""WITH {views.TELEMETRY}, {views.matches_sql()},
pl AS (SELECT seq, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS place FROM tel),
r AS (SELECT mat.*, place, place - row_number() OVER (PARTITION BY case_id, zone_id ORDER BY place) AS run FROM mat JOIN pl USING (seq))
SELECT case_id, zone_id, min(place) AS first_place, arg_min(ts, place) AS entry_ts, arg_max(ts, place) AS exit_ts, max(altitude_m) AS max_altitude_m, count(*) AS points
FROM r GROUP BY case_id, zone_id, run""",
)
def breach_episodes(spark, sf_dir):
    return geofence.breach_episodes(views.telemetry(spark, sf_dir), zones.zone_catalog(spark)).select("case_id", "zone_id", "first_place", "entry_ts", "exit_ts", "max_altitude_m", "points")


# ---------------------------------------------------------------- anomalies

_STEP = views.haversine_sql("pla", "plo", "latitude", "longitude")
_NEIGHBOURS = f"""WITH {views.EVENTS}, lagged AS (
  SELECT *, lag(ts) OVER w AS pts, lag(latitude) OVER w AS pla, lag(longitude) OVER w AS plo FROM tel WINDOW w AS (PARTITION BY case_id ORDER BY seq)),
nb AS (SELECT *, (epoch_us(ts) - epoch_us(pts)) / CAST(1000000 AS DOUBLE) AS gap, {_STEP} AS step FROM lagged),
found AS (
  SELECT case_id, seq, 1 AS check_no, CASE WHEN gap < 0 THEN 'CLOCK_SKEW' ELSE 'TIMESTAMP_GAP' END AS anomaly_type, CASE WHEN gap < 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         CASE WHEN gap < 0 THEN ts ELSE pts END AS ts FROM nb WHERE gap < 0 OR gap > {GAP_SECONDS}
  UNION ALL SELECT case_id, seq, 2, 'GPS_DISCORDANCE', 'HIGH', ts FROM nb WHERE gap > 0 AND step / gap > {JUMP_MPS}
  UNION ALL SELECT case_id, seq, 3, 'UNEXPECTED_DISARM', 'CRITICAL', ts FROM ev WHERE event_type = 'DISARM' AND altitude_m > 5)"""


def _anomalies(spark, sf_dir):
    return anomalies.anomaly_report(views.telemetry(spark, sf_dir), views.events(spark, sf_dir), gap_seconds=GAP_SECONDS, jump_mps=JUMP_MPS)


@query(
    "anomaly_report",
    _NEIGHBOURS + " SELECT case_id, printf('ANOM-%03d', row_number() OVER (PARTITION BY case_id ORDER BY check_no = 3, seq, check_no)) AS anomaly_id, seq, anomaly_type, severity, ts FROM found",
)
def anomaly_report(spark, sf_dir):
    return _anomalies(spark, sf_dir).select("case_id", "anomaly_id", "seq", "anomaly_type", "severity", "ts")


@query("gap_anomalies", _NEIGHBOURS + " SELECT case_id, seq, anomaly_type, ts, round(gap, 3) AS gap_sec FROM found JOIN (SELECT seq, gap FROM nb) USING (seq) WHERE check_no = 1")
def gap_anomalies(spark, sf_dir):
    rows = views.telemetry(spark, sf_dir)
    gaps = anomalies.neighbours(rows).select("seq", F.round("gap_sec", 3).alias("gap_sec"))
    found = anomalies.anomaly_candidates(rows, gap_seconds=GAP_SECONDS, jump_mps=JUMP_MPS).filter("check_no = 1")
    return found.join(gaps, "seq").select("case_id", "seq", "anomaly_type", "ts", "gap_sec")


@query("gps_jumps", _NEIGHBOURS + f" SELECT case_id, seq, round(step, 4) AS step_m, round(step / gap, 4) AS speed_mps FROM nb WHERE gap > 0 AND step / gap > {JUMP_MPS}")
def gps_jumps(spark, sf_dir):
    rows = anomalies.neighbours(views.telemetry(spark, sf_dir)).filter((F.col("gap_sec") > 0) & (F.col("step_m") / F.col("gap_sec") > JUMP_MPS))
    return rows.select("case_id", "seq", F.round("step_m", 4).alias("step_m"), F.round(F.col("step_m") / F.col("gap_sec"), 4).alias("speed_mps"))


@query("midair_disarm", _NEIGHBOURS + " SELECT case_id, seq, severity, ts FROM found WHERE check_no = 3")
def midair_disarm(spark, sf_dir):
    return anomalies.midair_disarms(views.events(spark, sf_dir)).select("case_id", "seq", "severity", "ts")


@query("anomaly_kinds", _NEIGHBOURS + " SELECT case_id, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severities, string_agg(DISTINCT anomaly_type, ',' ORDER BY anomaly_type) AS types FROM found GROUP BY case_id")
def anomaly_kinds(spark, sf_dir):
    found = detectors.kinds_found(anomalies.anomaly_candidates(views.telemetry(spark, sf_dir), views.events(spark, sf_dir), gap_seconds=GAP_SECONDS, jump_mps=JUMP_MPS))
    return found.select("case_id", F.array_join("severities", ",").alias("severities"), F.array_join("types", ",").alias("types"))


@query(
    "altitude_alerts",
    f"""WITH {views.TELEMETRY}, m AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY altitude_m DESC, seq) AS k FROM tel)
SELECT case_id, seq, ts, altitude_m, 'WARNING' AS severity FROM m WHERE k = 1 AND altitude_m > 120""",
)
def altitude_alerts(spark, sf_dir):
    return anomalies.altitude_alerts(views.telemetry(spark, sf_dir)).select("case_id", "seq", "ts", "altitude_m", "severity")


@query(
    "wgs84_validity",
    _NEIGHBOURS + " SELECT case_id, count(*) AS points, CAST(count_if(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND altitude_m >= 0) AS BIGINT) AS valid_points, bool_and(coalesce(gap >= 0, true)) AS chronological FROM nb GROUP BY case_id",
)
def wgs84_validity(spark, sf_dir):
    return anomalies.validity(views.telemetry(spark, sf_dir))


# ---------------------------------------------------------------- summaries and timeline


@query(
    "flight_summary",
    _NEIGHBOURS
    + """, s AS (SELECT case_id, arg_min(ts, seq) AS start_ts, arg_max(ts, seq) AS end_ts, round(sum(step), 2) AS total_distance_m, round(max(altitude_m), 2) AS max_altitude_m, round(max(ground_speed_mps), 2) AS max_speed_mps, count(*) AS telemetry_count FROM nb GROUP BY case_id),
d AS (SELECT case_id, arg_max(ts, seq) FILTER (WHERE event_type = 'DISARM') AS disarm, count(*) AS events_count FROM ev GROUP BY case_id)
SELECT case_id, round(greatest(0, (epoch_us(end_ts) - epoch_us(start_ts)) / CAST(1000000 AS DOUBLE)), 2) AS duration_sec, total_distance_m, max_altitude_m, max_speed_mps, start_ts, end_ts,
       start_ts AS arm_ts, coalesce(disarm, end_ts) AS disarm_ts, telemetry_count, events_count FROM s JOIN d USING (case_id)""",
)
def flight_summary(spark, sf_dir):
    return summary.flight_summary(views.telemetry(spark, sf_dir), views.events(spark, sf_dir))


@query(
    "telemetry_windows",
    f"""WITH {views.TELEMETRY}, p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM tel),
w AS (SELECT p.*, u.win FROM p, (SELECT unnest(generate_series(0, (SELECT max(n) FROM p) // 45)) AS win) u WHERE i >= 45 * win AND i < 45 * win + 60 AND (win = 0 OR 45 * (win - 1) + 60 < n))
SELECT case_id, win, arg_min(ts, i) AS start_ts, arg_max(ts, i) AS end_ts, min(altitude_m) AS min_altitude_m, max(altitude_m) AS max_altitude_m, round(avg(ground_speed_mps), 4) AS avg_speed_mps, max(ground_speed_mps) AS max_speed_mps,
       min(battery_pct) AS min_battery_pct, max(battery_pct) AS max_battery_pct, count(*) AS samples FROM w GROUP BY case_id, win""",
)
def telemetry_windows(spark, sf_dir):
    return summary.telemetry_windows(views.telemetry(spark, sf_dir))


@query(
    "downsampled_track",
    f"""WITH {views.TELEMETRY}, p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM tel)
SELECT case_id, seq, ts, altitude_m FROM p WHERE n <= 600 OR i % greatest(n // 200, 1) = 0""",
)
def downsampled_track(spark, sf_dir):
    return summary.downsample(views.telemetry(spark, sf_dir), most=600, aim=200).select("case_id", "seq", "ts", "altitude_m")


@query(
    "master_timeline",
    _NEIGHBOURS
    + f""", {views.matches_sql()}, t AS (
  SELECT case_id, ts, 'FLIGHT_EVENT' AS category, event_type, severity, altitude_m, 0 AS branch, seq, 0 AS z FROM ev
  UNION ALL SELECT case_id, ts, 'GEOFENCE_BREACH', CASE WHEN {_OVER} THEN 'CEILING_EXCEEDED' ELSE 'BOUNDARY_ENTRY' END, CASE WHEN nofly OR zone_class = 'RED' THEN 'CRITICAL' ELSE 'WARNING' END, altitude_m, 1, seq, zone_pos FROM mat
  UNION ALL SELECT case_id, ts, 'ANOMALY', anomaly_type, severity, NULL, 2, seq, check_no FROM found)
SELECT case_id, ts, category, event_type, severity, altitude_m, CAST(CASE WHEN event_type LIKE '%TAKEOFF%' THEN -5 WHEN event_type LIKE '%ARMED%' THEN -10 WHEN event_type LIKE '%LAND%' THEN 10 WHEN event_type LIKE '%DISARM%' THEN 20 ELSE 0 END AS BIGINT) AS priority FROM t""",
)
def master_timeline(spark, sf_dir):
    rows, ev = views.telemetry(spark, sf_dir), views.events(spark, sf_dir)
    found = timeline.master_timeline(ev, geofence.geofence_violations(rows, zones.zone_catalog(spark)), _anomalies(spark, sf_dir))
    return timeline.ordered_timeline(found).select("case_id", "ts", "category", "event_type", "severity", "altitude_m", "priority")


@query(
    "lifecycle_events",
    f"""WITH {views.EVENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS a, row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) AS z, row_number() OVER (PARTITION BY case_id ORDER BY altitude_m DESC, seq) AS k FROM tel),
m AS (
  SELECT case_id, 'ARM' AS event_type, ts, altitude_m, 'INFO' AS severity FROM f WHERE a = 1
  UNION ALL SELECT case_id, 'TAKEOFF', ts, altitude_m, 'INFO' FROM f WHERE a = 1
  UNION ALL SELECT case_id, 'LANDING', ts, altitude_m, 'INFO' FROM f WHERE z = 1
  UNION ALL SELECT case_id, 'DISARM', ts + INTERVAL 1 SECOND, 0, 'INFO' FROM f WHERE z = 1
  UNION ALL SELECT case_id, 'ERROR_ALERT', ts, altitude_m, 'WARNING' FROM f WHERE k = 1 AND altitude_m > 120)
SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.case_id = m.case_id AND ev.event_type = m.event_type)""",
)
def lifecycle_events(spark, sf_dir):
    return lifecycle.synth_lifecycle(views.telemetry(spark, sf_dir), views.events(spark, sf_dir)).select("case_id", "event_type", "ts", "altitude_m", "severity")


# ---------------------------------------------------------------- as-of joins

_NEAREST = f"""WITH {views.MEDIA}, firsts AS (SELECT case_id, ts, arg_min(seq, seq) AS seq, arg_min(altitude_m, seq) AS altitude_m, arg_min(latitude, seq) AS latitude FROM trk GROUP BY case_id, ts),
nr AS (
  SELECT m.case_id, m.media_id, m.ts, m.duration_sec, t.ts AS matched_ts, t.seq AS matched_seq, t.altitude_m, t.latitude, abs(epoch_us(m.ts) - epoch_us(t.ts)) / CAST(1000000 AS DOUBLE) AS delta
  FROM med m JOIN firsts t USING (case_id) QUALIFY row_number() OVER (PARTITION BY m.media_id ORDER BY abs(epoch_us(m.ts) - epoch_us(t.ts)), t.seq) = 1)"""


@query("nearest_media", _NEAREST + " SELECT case_id, media_id, ts AS capture_ts, matched_ts, matched_seq, altitude_m, delta <= 2 AS high_confidence FROM nr")
def nearest_media(spark, sf_dir):
    found = asof.nearest_media(views.media(spark, sf_dir), views.track(spark, sf_dir))
    return found.select("case_id", "media_id", "capture_ts", "matched_ts", "matched_seq", "altitude_m", "high_confidence")


_OVERLAP = (
    _NEAREST
    + """, win AS (SELECT case_id, min(ts) AS a, max(ts) AS b FROM trk GROUP BY case_id),
ov AS (SELECT nr.*, CASE WHEN duration_sec > 0 THEN greatest(nr.ts - INTERVAL 15 SECOND, a) <= least(nr.ts + INTERVAL 45 SECOND, b) OR delta <= 45 ELSE delta <= 60 END AS has_overlap FROM nr JOIN win USING (case_id))"""
)


@query("media_overlap", _OVERLAP + " SELECT case_id, media_id, has_overlap, CASE WHEN has_overlap THEN matched_seq END AS matched_seq FROM ov")
def media_overlap(spark, sf_dir):
    return asof.media_overlap(views.media(spark, sf_dir), views.track(spark, sf_dir)).select("case_id", "media_id", "has_overlap", "matched_seq")


@query("media_events", _OVERLAP + " SELECT case_id, media_id, ts, 'MEDIA_CAPTURE' AS event_type, altitude_m FROM ov WHERE has_overlap")
def media_events(spark, sf_dir):
    found = asof.media_events(asof.media_overlap(views.media(spark, sf_dir), views.track(spark, sf_dir)))
    return found.select("case_id", "media_id", "ts", "event_type", "altitude_m")


@query("media_capture", _OVERLAP + " SELECT case_id, media_id, has_overlap, CASE WHEN has_overlap THEN latitude ELSE media_id % 90 END AS latitude FROM ov")
def media_capture(spark, sf_dir):
    files = views.media(spark, sf_dir).withColumns({"tag_latitude": (F.col("media_id") % 90).cast("double"), "tag_longitude": F.lit(0.0), "tag_altitude_m": F.lit(0.0)})
    found = asof.media_capture(files, asof.media_overlap(files, views.track(spark, sf_dir)))
    return found.select("case_id", "media_id", "has_overlap", "latitude")


@query(
    "last_known_position",
    f"""WITH {views.EVENTS} SELECT e.case_id, e.seq AS event_id, e.event_type, arg_max(t.altitude_m, struct_pack(ts := t.ts, seq := t.seq)) AS altitude_m
FROM ev e LEFT JOIN tel t ON t.case_id = e.case_id AND t.ts <= e.ts AND t.raw_type = 'view' WHERE e.event_type = 'DISARM' GROUP BY e.case_id, e.seq, e.event_type""",
)
def last_known_position(spark, sf_dir):
    found = asof.last_known_position(views.events(spark, sf_dir).filter("event_type = 'DISARM'"), views.telemetry(spark, sf_dir).filter("raw_type = 'view'"))
    return found.select("case_id", "event_id", "event_type", "altitude_m")


@query(
    "arm_edges",
    f"""WITH {views.TELEMETRY}, e AS (SELECT *, altitude_m > 50 AS armed, lag(altitude_m > 50, 1, false) OVER (PARTITION BY case_id ORDER BY seq) AS was FROM tel)
SELECT case_id, seq, ts, CASE WHEN armed THEN 'ARM' ELSE 'DISARM' END AS event_type FROM e WHERE armed <> was""",
)
def arm_edges(spark, sf_dir):
    return asof.arm_edges(views.telemetry(spark, sf_dir), F.col("altitude_m") > 50).select("case_id", "seq", "ts", "event_type")


@query(
    "carry_forward",
    f"""WITH {views.TELEMETRY} SELECT case_id, seq, last_value(CASE WHEN seq % 4 = 0 THEN altitude_m END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS altitude_m FROM tel""",
)
def carry_forward(spark, sf_dir):
    sparse = views.telemetry(spark, sf_dir).withColumn("altitude_m", F.when(F.col("seq") % 4 == 0, F.col("altitude_m")))
    return asof.carry_forward(sparse, ["altitude_m"]).select("case_id", "seq", "altitude_m")


@query(
    "resample_1h",
    f"""WITH {views.TELEMETRY}, s AS (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY case_id) AS t0 FROM tel), k AS (SELECT *, (epoch_us(ts) - t0) // 3600000000 AS slot FROM s)
SELECT case_id, slot, make_timestamp(min(t0) + slot * 3600000000) AS slot_ts, arg_max(altitude_m, struct_pack(ts := ts, seq := seq)) AS altitude_m, count(*) AS rows_in_slot FROM k GROUP BY case_id, slot""",
)
def resample_1h(spark, sf_dir):
    return asof.resample(views.telemetry(spark, sf_dir), 3_600_000).select("case_id", "slot", "slot_ts", "altitude_m", "rows_in_slot")


# ---------------------------------------------------------------- missions

_COMPARED = f"""WITH {views.WAYPOINTS}, good AS (SELECT * FROM wp WHERE (abs(latitude) > 0.001 OR abs(longitude) > 0.001) AND command NOT IN ('HOME', 'RETURN_TO_LAUNCH')),
v AS (SELECT * FROM good UNION ALL SELECT * FROM wp WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.case_id = wp.case_id AND g.plan_id = wp.plan_id)),
cmp AS (SELECT v.case_id, v.plan_id, v.idx, v.command, min({views.haversine_sql("v.latitude", "v.longitude", "t.latitude", "t.longitude")}) AS d FROM v JOIN tel t USING (case_id) GROUP BY ALL)"""


@query("mission_compare", _COMPARED + " SELECT case_id, plan_id, idx, command, round(d, 2) AS closest_distance_m, d <= 25 AS reached FROM cmp")
def mission_compare(spark, sf_dir):
    found = mission.mission_compare(views.waypoints(spark, sf_dir), views.telemetry(spark, sf_dir))
    return found.select("case_id", "plan_id", "idx", "command", "closest_distance_m", "reached")


@query(
    "mission_compliance",
    _COMPARED
    + """ SELECT case_id, plan_id, round(count_if(d <= 25) / count(*) * 100, 1) AS compliance_pct, count(*) AS waypoints_total, CAST(count_if(d <= 25) AS BIGINT) AS waypoints_reached, CAST(count_if(d > 25) AS BIGINT) AS waypoints_missed,
  round(avg(d), 2) AS mean_deviation_m, round(max(d), 2) AS max_deviation_m, count_if(d <= 25) > 0 AND count_if(d <= 25) < count(*) AND NOT arg_max(d <= 25, idx) AS interrupted FROM cmp GROUP BY case_id, plan_id""",
)
def mission_compliance(spark, sf_dir):
    return mission.mission_compliance(mission.mission_compare(views.waypoints(spark, sf_dir), views.telemetry(spark, sf_dir)))


@query(
    "plan_metrics",
    f"""WITH {views.WAYPOINTS}, l AS (SELECT *, lag(latitude) OVER w AS pla, lag(longitude) OVER w AS plo FROM wp WINDOW w AS (PARTITION BY case_id, plan_id ORDER BY idx))
SELECT case_id, plan_id, count(*) AS waypoints, round(coalesce(sum({_STEP}), 0), 2) AS planned_distance_m, max(altitude_m) AS planned_max_altitude_m FROM l GROUP BY case_id, plan_id""",
)
def plan_metrics(spark, sf_dir):
    return mission.plan_metrics(views.waypoints(spark, sf_dir))


# ---------------------------------------------------------------- evidence and custody


@query("hash_manifest", f"WITH {views.EVIDENCE} SELECT item_id, sha256(content) AS sha256, md5(content) AS md5, CAST(strlen(content) AS BIGINT) AS byte_count FROM evi")
def hash_manifest(spark, sf_dir):
    return evidence.hash_manifest(views.evidence(spark, sf_dir), F.col("content"), sha3=False).select("item_id", "sha256", "md5", "byte_count")


@query("hash_manifest_sha3")
def hash_manifest_sha3(spark, sf_dir):
    return evidence.hash_manifest(views.evidence(spark, sf_dir), F.col("content")).select("item_id", "sha3_256")


@query(
    "verify_manifest",
    f"""WITH {views.EVIDENCE}, x AS (SELECT item_id, row_number() OVER () AS r, md5(content) AS m FROM evi)
SELECT item_id, substr(m, 1, 1) NOT IN ('0', '1') AND substr(m, 1, 1) <> '2' AS sha256_match, substr(m, 1, 1) NOT IN ('0', '1') AS md5_match, substr(m, 1, 1) NOT IN ('0', '1') AS bytes_match,
       substr(m, 1, 1) NOT IN ('0', '1', '2') AS is_valid FROM x""",
)
def verify_manifest(spark, sf_dir):
    computed = evidence.hash_manifest(views.evidence(spark, sf_dir), F.col("content"), sha3=False)
    # The expected manifest lacks some items, has some hashes wrong, and is in upper case.
    first = F.substring("md5", 1, 1)
    expected = computed.filter(~first.isin("0", "1")).select("item_id", F.when(first == "2", "0").otherwise(F.upper("sha256")).alias("sha256"), F.upper("md5").alias("md5"), "byte_count")
    return evidence.verify_manifest(expected, computed.select("item_id", "sha256", "md5", "byte_count"))


@query("acquisition_totals", f"WITH {views.EVIDENCE} SELECT case_id, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM evi GROUP BY case_id")
def acquisition_totals(spark, sf_dir):
    return evidence.acquisition_totals(views.evidence(spark, sf_dir).withColumn("byte_count", F.octet_length("content").cast("long")))


def _classified(spark, sf_dir):
    return views.evidence(spark, sf_dir).withColumn("head", evidence.head_text(F.col("content"))).withColumn("category", evidence.classify(F.col("path"), F.col("head")))


_CLASSES = f"""WITH {views.EVIDENCE}, cls AS (
  SELECT *, CASE WHEN regexp_matches(path, '\\.(plan|kml)$') THEN 'GCS' WHEN regexp_matches(left(content, 500), '<kml|<wpml') THEN 'GCS'
    WHEN path LIKE '%.json' AND regexp_matches(left(content, 500), 'gs_pro|gs pro|gspro|dji|flightplan|freeflight|parrot|inav|mwp', 'i') THEN 'GCS'
    WHEN regexp_matches(path, '\\.(mp4|jpg)$') THEN 'VIDEO_IMAGES' ELSE 'LOGS' END AS category FROM evi)"""


@query("classify_evidence", _CLASSES + " SELECT item_id, path, category, CASE category WHEN 'GCS' THEN 'gcs' WHEN 'LOGS' THEN 'logs' ELSE 'video_images' END AS folder FROM cls")
def classify_evidence(spark, sf_dir):
    return _classified(spark, sf_dir).select("item_id", "path", "category", evidence.category_folder(F.col("category")).alias("folder"))


@query("evidence_counts", _CLASSES + " SELECT case_id, CAST(count_if(category = 'LOGS') AS BIGINT) AS logs, CAST(count_if(category = 'VIDEO_IMAGES') AS BIGINT) AS video_images, CAST(count_if(category = 'GCS') AS BIGINT) AS gcs, count(*) AS total FROM cls GROUP BY case_id")
def evidence_counts(spark, sf_dir):
    return summary.evidence_counts(_classified(spark, sf_dir))


_EXT, _HEAD = "regexp_extract(path, '(\\.[a-z]+)$', 1)", "left(content, 2048)"


@query(
    "detect_platform",
    f"""WITH {views.EVIDENCE}, h AS (SELECT item_id, {_EXT} AS ext, {_HEAD} AS head FROM evi)
SELECT item_id, CASE WHEN ext = '.txt' AND regexp_matches(head, 'OSD\\.|CUSTOM\\.|DJI|flycState') THEN 'dji' WHEN ext = '.txt' AND regexp_matches(head, 'FMT,|QGC WPL') THEN 'ardupilot' WHEN ext = '.plan' AND regexp_matches(head, 'QGroundControl|Plan') THEN 'ardupilot'
    WHEN ext = '.csv' AND regexp_matches(split_part(head, chr(10), 1), 'timestamp.*(lat|vehicle_gps|lon)|(lat|vehicle_gps|lon).*timestamp') THEN 'px4' WHEN ext = '.json' AND NOT regexp_matches(head, 'gs_pro|home_location|DJI') AND regexp_matches(head, 'parrot|anafi|bebop|run_id|flightplan', 'i') THEN 'parrot'
    WHEN ext = '.txt' AND regexp_matches(head, 'feature GPS|set nav_|set craft_name|# diff|H Product:Blackbox|H Firmware type:(Betaflight|INAV)') THEN 'betaflight' WHEN ext = '.bin' THEN 'ardupilot' WHEN ext = '.ulg' THEN 'px4' ELSE 'dji' END AS platform,
  CASE WHEN ext = '.plan' THEN 'QGroundControl' WHEN ext = '.txt' AND contains(split_part(head, chr(10), 1), 'QGC WPL') THEN 'QGroundControl / Mission Planner' WHEN ext = '.kml' AND regexp_matches(head, 'wpml:|(?i:dji)') THEN 'DJI Pilot 2 (WPML)'
    WHEN ext = '.json' AND regexp_matches(head, 'gs_pro|gs pro|gspro|dji', 'i') THEN 'DJI GS Pro' WHEN ext = '.json' AND regexp_matches(head, 'flightplan|freeflight|parrot', 'i') THEN 'Parrot FlightPlan' WHEN ext = '.json' AND regexp_matches(head, 'inav|mwp', 'i') THEN 'iNav Mission Planner' END AS station,
  CASE WHEN ext = '.csv' AND regexp_matches(split_part(head, chr(10), 1), 'phone_latitude', 'i') THEN 'Litchi for DJI Drones' WHEN ext = '.csv' AND regexp_matches(split_part(head, chr(10), 1), 'autel|flightrecord', 'i') THEN 'Autel Explorer' WHEN ext = '.txt' AND regexp_matches(head, 'speedybee', 'i') THEN 'SpeedyBee Mobile App'
    WHEN ext = '.json' AND regexp_matches(head, 'freeflight|anafi|bebop|parrot|gutma|flight_logging', 'i') THEN 'Parrot FreeFlight 6' END AS app_name FROM h""",
)
def detect_platform(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    station, app = evidence.ground_station(F.col("path"), F.col("head")), evidence.companion_app(F.col("path"), F.col("head"))
    return rows.select("item_id", evidence.detect_platform(F.col("path"), F.col("head")).alias("platform"), station["station"].alias("station"), app["app_name"].alias("app_name"))


@query(
    "sync_status",
    f"WITH {views.EVENTS}, {views.EVIDENCE}, e AS (SELECT case_id, count(*) AS n FROM ev GROUP BY case_id), f AS (SELECT case_id, count(*) AS n FROM evi GROUP BY case_id) SELECT case_id, e.n AS events_count, coalesce(f.n, 0) AS evidence_count FROM e LEFT JOIN f USING (case_id)",
)
def sync_status(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return summary.sync_status(ev, events=ev, evidence=views.evidence(spark, sf_dir))


@query(
    "custody_links",
    f"""WITH h AS (SELECT conv_id AS case_id, turn AS entry_id, sha256(conv_id || '|' || turn || '|' || coalesce(role, '') || '|NOTE|' || coalesce(text, '')) AS entry_hash FROM conversations)
SELECT *, lag(entry_hash, 1, '{custody.GENESIS}') OVER (PARTITION BY case_id ORDER BY entry_id) AS previous_entry_hash FROM h""",
)
def custody_links(spark, sf_dir):
    return custody.link_table(views.custody(spark, sf_dir))


def _pad(byte: int) -> str:
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in EXAMPLE_KEY.ljust(custody.BLOCK, b"\0")) + "'::BLOB"


_SIGNED = f"sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(message))))"


@query(
    "custody_chain",
    f"""WITH RECURSIVE e AS (SELECT conv_id AS case_id, turn AS entry_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, conv_id || '|t' || turn || '|' || coalesce(role, '') || '|NOTE|' || coalesce(text, '') || '||' AS body FROM conversations),
c AS (
  SELECT case_id, entry_id, k, previous_hash, {_SIGNED} AS signature FROM (SELECT *, '{custody.GENESIS}' AS previous_hash, body || '{custody.GENESIS}' AS message FROM e WHERE k = 1)
  UNION ALL
  SELECT case_id, entry_id, k, previous_hash, {_SIGNED} FROM (SELECT e.*, c.signature AS previous_hash, e.body || c.signature AS message FROM c JOIN e ON e.case_id = c.case_id AND e.k = c.k + 1))
SELECT case_id, entry_id, previous_hash, signature FROM c""",
)
def custody_chain(spark, sf_dir):
    return custody.chain_append(views.custody(spark, sf_dir), EXAMPLE_KEY).select("case_id", "entry_id", "previous_hash", "signature")


@query(
    "custody_verify",
    "SELECT conv_id AS case_id, conv_id % 3 <> 0 OR max(turn) = 0 AND false AS valid, CASE WHEN conv_id % 3 = 0 THEN 'Tampered entry #' || min(turn) || ': signature mismatch. Integrity compromised.' END AS message, count(*) AS entries FROM conversations GROUP BY conv_id",
)
def custody_verify(spark, sf_dir):
    chain = custody.chain_append(views.custody(spark, sf_dir), EXAMPLE_KEY)
    edited = chain.withColumn("details", F.when((F.col("case_id") % 3 == 0), F.concat("details", F.lit("!"))).otherwise(F.col("details")))
    return custody.chain_verify(edited, EXAMPLE_KEY)


# ---------------------------------------------------------------- companion apps


@query(
    "account_fields",
    """WITH p AS (SELECT user_id AS case_id, event_id AS pos, (['Email', 'nick', 'uid', 'phone_no'])[event_id % 4 + 1] AS k, CAST(event_id AS VARCHAR) AS v FROM events)
SELECT case_id, arg_max(v, pos) FILTER (WHERE k = 'Email') AS email, arg_max(v, pos) FILTER (WHERE k = 'nick') AS pilot_name, arg_max(v, pos) FILTER (WHERE k = 'phone_no') AS phone, arg_min(v, pos) FILTER (WHERE k = 'uid') AS user_id FROM p GROUP BY case_id""",
)
def account_fields(spark, sf_dir):
    key = F.element_at(F.array(*[F.lit(x) for x in ("Email", "nick", "uid", "phone_no")]), (F.col("event_id") % 4 + 1).cast("int"))
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("pos"), key.alias("key"), F.col("event_id").cast("string").alias("value"))
    return mobile.account_fields(pairs)


def _apps(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("LOG", "PLAN", "MEDIA", "HARDWARE")]), (F.col("event_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string"))
    return rows.select((F.col("user_id") % 10).alias("case_id"), F.col("event_type").alias("app_name"), kind.alias("kind"), name.alias("name"), F.lit("v").alias("value"), F.col("event_id").alias("points"))


@query(
    "mobile_overview",
    """SELECT user_id % 10 AS case_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS apps, string_agg(DISTINCT CASE WHEN event_type IN ('click', 'view') THEN 'P1' ELSE 'Generic Mobile' END, ',' ORDER BY CASE WHEN event_type IN ('click', 'view') THEN 'P1' ELSE 'Generic Mobile' END) AS platforms,
       CAST(sum(event_id) AS BIGINT) AS points, count(*) AS files FROM events GROUP BY 1""",
)
def mobile_overview(spark, sf_dir):
    catalog = spark.createDataFrame([("Click", "a.b", "P1"), ("view", "a.c", "P1")], "app_name string, package_id string, platform string")
    found = mobile.mobile_overview(mobile.with_app_catalog(mobile.mobile_artifacts(_apps(spark, sf_dir)), catalog))
    return found.select("case_id", F.array_join("apps", ",").alias("apps"), F.array_join("platforms", ",").alias("platforms"), "points", "files")


@query(
    "operator_locations",
    "SELECT user_id % 10 AS case_id, min(event_id) AS pos, CAST(event_id % 7 AS DOUBLE) AS latitude, CAST(1 AS DOUBLE) AS longitude FROM events GROUP BY user_id % 10, event_id % 7",
)
def operator_locations(spark, sf_dir):
    near = (F.col("event_id") % 3) * 1e-7  # well inside the distance at which two fixes are one
    fixes = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("case_id"), F.col("event_id").alias("pos"), ((F.col("event_id") % 7) + near).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit("phone").alias("source"))
    return mobile.operator_locations(fixes).select("case_id", "pos", F.round("latitude", 3).alias("latitude"), "longitude")


# ---------------------------------------------------------------- retrieval

_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "chunk_events",
    f"""WITH {views.EVENTS} SELECT case_id || '_flight_event_' || seq AS chunk_id, '[FLIGHT_EVENT] Type: ' || event_type || ' | Severity: ' || severity || ' | Time (UTC): ' || {_STAMP} || ' | Location: ' ||
  printf('lat=%.6f, lon=%.6f, alt=%.1fm', latitude, longitude, altitude_m) || ' | Description: ' || description AS text FROM ev""",
)
def chunk_events(spark, sf_dir):
    return retrieval.all_chunks(retrieval.chunk_events(views.events(spark, sf_dir))).select("chunk_id", "text")


@query(
    "chunk_count",
    _NEIGHBOURS + f", {views.matches_sql()}, c AS (SELECT case_id FROM ev UNION ALL SELECT case_id FROM mat UNION ALL SELECT case_id FROM found) SELECT case_id, count(*) AS chunks, true AS ready FROM c GROUP BY case_id",
)
def chunk_count(spark, sf_dir):
    rows, ev = views.telemetry(spark, sf_dir), views.events(spark, sf_dir)
    parts = (retrieval.chunk_events(ev), retrieval.chunk_violations(geofence.geofence_violations(rows, zones.zone_catalog(spark))), retrieval.chunk_anomalies(_anomalies(spark, sf_dir)))
    return retrieval.chunk_count(retrieval.all_chunks(*parts))


@query(
    "hash_embed",
    """WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text, regexp_replace(regexp_replace(lower(translate(coalesce(text, ''), ',|:', '   ')), '^\\s+', ''), '\\s+$', '') AS clean FROM documents),
term AS (
  SELECT id, code % 768 AS dim, CASE WHEN (code >> 16) & 1 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS v FROM (SELECT id, ('0x' || left(sha256(w), 8))::BIGINT AS code FROM (SELECT id, unnest(regexp_split_to_array(clean, '\\s+')) AS w FROM d WHERE clean <> ''))
  UNION ALL
  SELECT id, (code >> 4) % 768, 0.5::DOUBLE FROM (SELECT id, ('0x' || left(md5(lower(substring(text, i, 3))), 8))::BIGINT AS code FROM (SELECT id, text, unnest(range(1, length(text) - 1)) AS i FROM d WHERE clean <> ''))),
raw AS (SELECT id, dim, sum(v) AS v FROM term GROUP BY id, dim),
norm AS (SELECT id, sqrt(sum(v * v)) AS n FROM raw GROUP BY id)
SELECT d.id, CASE WHEN max(coalesce(n, 0)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS self_cosine,
  sha256(string_agg(CAST(round(CAST(CAST(coalesce(raw.v / n, 0) AS FLOAT) AS DOUBLE) * 100000) AS BIGINT), ',' ORDER BY k.dim)) AS digest
FROM d CROSS JOIN (SELECT unnest(range(768)) AS dim) k LEFT JOIN norm USING (id) LEFT JOIN raw ON raw.id = d.id AND raw.dim = k.dim GROUP BY d.id""",
)
def hash_embed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.transform("embedding", lambda v: F.round(v.cast("double") * 100_000).cast("long").cast("string"))
    found = retrieval.hash_embed(rows).select("id", "embedding", retrieval.length(F.col("embedding")).alias("n"))
    return found.select("id", F.round(F.when(F.col("n") > 0, F.col("n") * F.col("n")).otherwise(0.0), 4).alias("self_cosine"), F.sha2(F.array_join(whole, ","), 256).alias("digest"))


@query(
    "topk_vectors",
    """WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 4) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.label >= 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p QUALIFY rank <= 10""",
)
def topk_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.lit(0).alias("case_id"))
    return retrieval.top_k(asked, rows.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), where=F.col("label") >= 0, per_case=False)


# ---------------------------------------------------------------- scores and exports


@query(
    "detector_quality",
    """WITH d AS (SELECT quality, CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS p, toxic AS a FROM documents JOIN labels USING (doc_id)),
c AS (SELECT quality, CAST(count_if(p = 1 AND a = 1) AS BIGINT) AS tp, CAST(count_if(p = 1 AND a = 0) AS BIGINT) AS fp, CAST(count_if(p = 0 AND a = 1) AS BIGINT) AS fn, CAST(count_if(p = 0 AND a = 0) AS BIGINT) AS tn FROM d GROUP BY quality)
SELECT CAST(quality AS BIGINT) AS quality, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM c""",
)
def detector_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return detectors.detector_quality(rows.withColumns({"predicted": F.when(F.col("n_chars") % 2 == 0, 1).otherwise(0), "actual": F.col("toxic")}), ["quality"])


@query(
    "suite_score",
    "SELECT source AS suite, count(*) AS checks, CAST(count_if(n_chars > 300) AS BIGINT) AS passed, round(count_if(n_chars > 300) / count(*) * 100, 1) AS score_pct, bool_and(n_chars > 300) AS all_passed FROM documents GROUP BY ROLLUP (source)",
)
def suite_score(spark, sf_dir):
    return detectors.suite_score(table(spark, sf_dir, "documents").select(F.col("source").alias("suite"), (F.col("n_chars") > 300).alias("passed")))


@query(
    "geojson_track",
    f"""WITH {views.TELEMETRY}, p AS (SELECT *, '[' || longitude || ',' || latitude || ',' || altitude_m || ']' AS pt, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM tel)
SELECT case_id, '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || string_agg(pt, ',' ORDER BY seq) || ']}},"properties":{{"name":"UAV Flight Trajectory","points_count":' || count(*) || '}}}},{{"type":"Feature","geometry":{{"type":"Point","coordinates":'
  || arg_min(pt, seq) || '}},"properties":{{"name":"Takeoff / Origin","timestamp":"' || arg_min(stamp, seq) || '"}}}},{{"type":"Feature","geometry":{{"type":"Point","coordinates":' || arg_max(pt, seq) || '}},"properties":{{"name":"Final Position / Landing","timestamp":"' || arg_max(stamp, seq) || '"}}}}]}}' AS geojson FROM p GROUP BY case_id""",
)
def geojson_track(spark, sf_dir):
    return sinks.to_geojson(views.telemetry(spark, sf_dir))


@query(
    "kml_track",
    f"""WITH {views.TELEMETRY} SELECT case_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>UAV Flight</name><Placemark><name>3D Flight Path</name><LineString><extrude>1</extrude><tessellate>1</tessellate><altitudeMode>relativeToGround</altitudeMode><coordinates>' || chr(10)
  || string_agg(concat_ws(',', longitude, latitude, altitude_m), chr(10) ORDER BY seq) || chr(10) || '</coordinates></LineString></Placemark></Document></kml>' AS kml FROM tel GROUP BY case_id""",
)
def kml_track(spark, sf_dir):
    return sinks.to_kml(views.telemetry(spark, sf_dir))


_CLOCK_SQL = "printf('%02d:%02d:%02d,000', ({0}) // 3600, ({0}) // 60 % 60, ({0}) % 60)"


@query(
    "srt_track",
    f"""WITH r AS ({ORACLE_SQL["resample_1h"].replace(" AS altitude_m, count", " AS altitude_m, arg_max(latitude, struct_pack(ts := ts, seq := seq)) AS latitude, arg_max(longitude, struct_pack(ts := ts, seq := seq)) AS longitude, count")})
SELECT case_id, slot, slot + 1 || chr(10) || {_CLOCK_SQL.format("slot * 3600")} || ' --> ' || {_CLOCK_SQL.format("slot * 3600 + 3600")} || chr(10) || printf('[latitude: %.7f] [longitude: %.7f] [altitude: %.2f]', latitude, longitude, altitude_m) || chr(10) AS srt FROM r""",
)
def srt_track(spark, sf_dir):
    return sinks.to_srt(asof.resample(views.telemetry(spark, sf_dir), 3_600_000), 3_600_000)


@query("case_json")
def case_json(spark, sf_dir):
    rows, ev = views.telemetry(spark, sf_dir), views.events(spark, sf_dir)
    found = summary.flight_summary(rows, ev)
    return sinks.case_json(found, anomalies=_anomalies(spark, sf_dir).select("case_id", "anomaly_id", "anomaly_type"), plans=mission.plan_metrics(views.waypoints(spark, sf_dir)))


# ---------------------------------------------------------------- streams


@query(
    "stream_geofence",
    f"WITH {views.TELEMETRY}, {views.matches_sql()} SELECT case_id, seq, zone_id FROM mat",
)
def stream_geofence(spark, sf_dir):
    return jobs.run_geofence(spark, sf_dir)


@query("stream_summary", f"WITH {views.TELEMETRY} SELECT case_id, count(*) AS points, max(altitude_m) AS max_altitude_m, max(ground_speed_mps) AS max_speed_mps FROM tel GROUP BY case_id")
def stream_summary(spark, sf_dir):
    return jobs.run_summary(spark, sf_dir)


@query("stream_dedupe", "SELECT count(DISTINCT sha256(coalesce(text, ''))) AS files FROM documents")
def stream_dedupe(spark, sf_dir):
    return jobs.run_dedupe(spark, sf_dir)
