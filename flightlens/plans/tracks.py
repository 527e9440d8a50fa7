"""Queries of sampled tracks, nearest points and thinned positions, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightlens.operators import asof, detectors, evidence, geofence, mission, mobile, sinks
from flightlens.plans import views
from flightlens.plans.catalog import query
from flightlens.session import table
from flightlens.sources import registry, zones

STEP_S = 3_600

#: Every fourth row is an attitude message, the others are fixes.
_MESSAGES = f"""WITH {views.TELEMETRY}, m AS (
  SELECT case_id, seq, ts, CASE WHEN seq % 4 <> 0 THEN latitude END AS latitude, CASE WHEN seq % 4 <> 0 THEN longitude END AS longitude, CASE WHEN seq % 4 <> 0 THEN altitude_m END AS altitude_m,
         CASE WHEN seq % 4 = 0 THEN CAST(seq % 90 AS DOUBLE) END AS roll_deg, CASE WHEN seq % 4 = 0 THEN CAST(-(seq % 45) AS DOUBLE) END AS pitch_deg, CASE WHEN seq % 4 = 0 THEN CAST(seq % 360 AS DOUBLE) END AS yaw_deg FROM tel),
i AS (SELECT *, row_number() OVER w - 1 AS i, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY case_id)) // {STEP_S * 1_000_000} AS slot,
         {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS l_{c}" for c in ("latitude", "longitude", "altitude_m", "roll_deg", "pitch_deg", "yaw_deg"))} FROM m WINDOW w AS (PARTITION BY case_id ORDER BY ts, seq)),
b AS (SELECT *, coalesce(i - 1 + min(slot + 1 - i) OVER (PARTITION BY case_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
x AS (SELECT *, before + 1 AS number FROM b WHERE slot >= before)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.telemetry(spark, sf_dir)
    fix, turn = F.col("seq") % 4 != 0, F.col("seq") % 4 == 0
    fixes = {c: F.when(fix, F.col(c)) for c in ("latitude", "longitude", "altitude_m")}
    turns = {"roll_deg": F.col("seq") % 90, "pitch_deg": -(F.col("seq") % 45), "yaw_deg": F.col("seq") % 360}
    return rows.withColumns(fixes | {c: F.when(turn, v.cast("double")) for c, v in turns.items()})


@query("track_emissions", _MESSAGES + f" SELECT case_id, number, (number - 1) * {STEP_S * 1000} AS clock_ms, ts, {', '.join(f'l_{c} AS {c}' for c in ('latitude', 'longitude', 'altitude_m', 'roll_deg', 'pitch_deg', 'yaw_deg'))} FROM x")
def track_emissions(spark, sf_dir):
    return asof.emissions(messages(spark, sf_dir), STEP_S * 1000)


_CLOCK = "printf('%02d:%02d:%02d,000', ({0}) // 3600, ({0}) // 60 % 60, ({0}) % 60)"


@query(
    "srt_emissions",
    _MESSAGES + f""" SELECT case_id, number, number || chr(10) || {_CLOCK.format(f"(number - 1) * {STEP_S}")} || ' --> ' || {_CLOCK.format(f"number * {STEP_S}")} || chr(10) ||
  printf('[latitude: %.7f] [longitude: %.7f] [altitude: %.2fm] [roll: %.1f] [pitch: %.1f] [yaw: %.1f]', coalesce(l_latitude, 0), coalesce(l_longitude, 0), coalesce(l_altitude_m, 0), coalesce(l_roll_deg, 0), coalesce(l_pitch_deg, 0), coalesce(l_yaw_deg, 0)) || chr(10) AS srt FROM x""",
)
def srt_emissions(spark, sf_dir):
    return sinks.emissions_to_srt(asof.emissions(messages(spark, sf_dir), STEP_S * 1000), STEP_S * 1000)


@query(
    "mission_nearest",
    f"""WITH {views.TELEMETRY}, w AS (SELECT case_id, seq % 7 AS plan_id, seq AS idx, latitude + (seq % 11 - 5) / CAST(1000 AS DOUBLE) AS latitude, longitude + (seq % 13 - 6) * CASE WHEN seq % 3 = 0 THEN 10.0 ELSE 0.001 END AS longitude FROM tel WHERE seq % 50 = 0)
SELECT w.case_id, w.plan_id, w.idx, round(min({views.haversine_sql("w.latitude", "w.longitude", "t.latitude", "t.longitude")}), 2) AS closest_distance_m, min({views.haversine_sql("w.latitude", "w.longitude", "t.latitude", "t.longitude")}) <= 25 AS reached
FROM w JOIN tel t USING (case_id) GROUP BY ALL""",
)
def mission_nearest(spark, sf_dir):
    """Waypoints beside the track and far from it."""
    rows = views.telemetry(spark, sf_dir)
    aside = F.when(F.col("seq") % 3 == 0, 10.0).otherwise(0.001)
    plan = rows.filter("seq % 50 = 0").select(
        "case_id", (F.col("seq") % 7).alias("plan_id"), F.col("seq").alias("idx"), F.lit("WAYPOINT").alias("command"), (F.col("latitude") + (F.col("seq") % 11 - 5) / F.lit(1000.0)).alias("latitude"), (F.col("longitude") + (F.col("seq") % 13 - 6) * aside).alias("longitude"), "altitude_m",
    )
    return mission.mission_compare(plan, rows).select("case_id", "plan_id", "idx", "closest_distance_m", "reached")


@query(
    "verify_manifest_sha3",
    f"""WITH {views.EVIDENCE}, x AS (SELECT item_id, substr(md5(content), 1, 1) AS m FROM evi)
SELECT item_id, true AS sha256_match, true AS md5_match, true AS bytes_match, m <> '7' AS sha3_256_match, m <> '7' AS is_valid FROM x""",
)
def verify_manifest_sha3(spark, sf_dir):
    computed = evidence.hash_manifest(views.evidence(spark, sf_dir), F.col("content"))
    wrong = F.when(F.substring("md5", 1, 1) == "7", F.reverse("sha3_256")).otherwise(F.upper("sha3_256"))
    expected = computed.select("item_id", "sha256", "md5", "byte_count", wrong.alias("sha3_256"))
    return evidence.verify_manifest(expected, computed.select("item_id", "sha256", "md5", "byte_count", "sha3_256"))


@query("suites_overview", "WITH s AS (SELECT source, round(count_if(n_chars > 300) / count(*) * 100, 1) AS p, bool_and(n_chars > 300) AS a FROM documents GROUP BY source) SELECT count(*) AS suites, CAST(count_if(a) AS BIGINT) AS suites_passed, round(avg(p), 1) AS mean_score_pct FROM s")
def suites_overview(spark, sf_dir):
    return detectors.suites_overview(table(spark, sf_dir, "documents").select(F.col("source").alias("suite"), (F.col("n_chars") > 300).alias("passed")))


_WINDOWS = "CASE WHEN zone_pos % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS active_from, CASE WHEN zone_pos % 2 = 0 THEN TIMESTAMP '2024-01-20' END AS active_to"


@query(
    "geofence_in_window",
    f"""WITH {views.TELEMETRY}, {views.matches_sql()}, a AS (SELECT *, {_WINDOWS} FROM mat)
SELECT case_id, zone_id, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts FROM a WHERE (active_from IS NULL OR ts >= active_from) AND (active_to IS NULL OR ts <= active_to) GROUP BY case_id, zone_id""",
)
def geofence_in_window(spark, sf_dir):
    """Zones that are active from a day on, up to a day, between both, or always."""
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    zone_table = zones.zone_catalog(spark).withColumns({"active_from": F.when(F.col("zone_pos") % 3 == 0, at(10)), "active_to": F.when(F.col("zone_pos") % 2 == 0, at(20))})
    found = geofence.geofence_violations(views.telemetry(spark, sf_dir), zone_table)
    return found.groupBy("case_id", "zone_id").agg(F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "files_by_reader",
    f"WITH {views.EVIDENCE}, r(pos, name, exts) AS (VALUES " + ", ".join(f"({i}, '{r.name}', {list(r.extensions)})" for i, r in enumerate(registry.Registry().readers)) + ") SELECT pos, name, CAST(count(item_id) AS BIGINT) AS files FROM r LEFT JOIN evi ON list_contains(exts, regexp_extract(path, '\\.[a-z0-9]+$')) GROUP BY pos, name",
)
def files_by_reader(spark, sf_dir):
    """The readers in their order, with the evidence files whose extension each may take."""
    readers = registry.Registry().table(spark).select("pos", "name", F.explode("extensions").alias("extension"))
    items = views.evidence(spark, sf_dir).select("item_id", F.regexp_extract("path", r"(\.[a-z0-9]+)$", 1).alias("extension"))
    return readers.join(items, "extension", "left").groupBy("pos", "name").agg(F.count("item_id").alias("files"))


@query(
    "pilots_of_apps",
    """WITH p AS (SELECT user_id % 10 AS case_id, 'app' || user_id % 3 AS app_name, event_id AS pos, (['Email', 'nick', 'uid', 'phone_no'])[event_id % 4 + 1] AS k, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS v, event_id % 17 AS spot FROM events),
a AS (SELECT case_id, app_name, count(DISTINCT spot) AS operator_fixes, coalesce(arg_max(v, pos) FILTER (WHERE k = 'Email' AND v <> ''), '') AS email, coalesce(arg_max(v, pos) FILTER (WHERE k = 'phone_no' AND v <> ''), '') AS phone,
  coalesce(arg_max(v, pos) FILTER (WHERE k = 'nick' AND v <> ''), '') AS nick, coalesce(arg_min(v, pos) FILTER (WHERE k = 'uid'), '') AS uid FROM p GROUP BY ALL)
SELECT case_id, app_name, operator_fixes, concat_ws(',', CASE WHEN email <> '' THEN 'email=' || email END, CASE WHEN phone <> '' THEN 'phone=' || phone END, CASE WHEN nick <> '' THEN 'pilot_name=' || nick END, CASE WHEN uid <> '' THEN 'user_id=' || uid END) AS pilot_account FROM a""",
)
def pilots_of_apps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("case_id"), F.concat(F.lit("app"), (F.col("user_id") % 3).cast("string")).alias("app_name"), F.col("event_id").alias("pos"))
    named = F.element_at(F.array(*map(F.lit, ("Email", "nick", "uid", "phone_no"))), (F.col("pos") % 4 + 1).cast("int"))
    pairs = rows.select("*", named.alias("key"), F.when(F.col("pos") % 6 != 0, F.col("pos").cast("string")).otherwise("").alias("value"))
    fixes = rows.select("*", (F.col("pos") % 17).cast("double").alias("latitude"), F.lit(1.0).alias("longitude"), F.lit("PHONE").alias("source"))
    logs = rows.select("case_id", "app_name", F.lit("LOG").alias("kind"), F.lit("log").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("points"))
    found = mobile.with_pilots(mobile.mobile_artifacts(logs), mobile.account_fields(pairs, ("case_id", "app_name")), fixes)
    shown = F.transform(F.array_sort(F.map_entries("pilot_account")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("case_id", "app_name", "operator_fixes", F.array_join(shown, ",").alias("pilot_account"))


@query("operator_places", f"WITH {views.TELEMETRY} SELECT case_id, min(seq) AS pos FROM tel GROUP BY case_id, floor(latitude * 10), floor(longitude * 10)")
def operator_places(spark, sf_dir):
    """Operator positions of the whole track, at one place in each tenth of a degree: what isn't the first there stands a hair beside it."""
    rows = views.telemetry(spark, sf_dir).select("case_id", F.col("seq").alias("pos"), F.floor(F.col("latitude") * 10).alias("y"), F.floor(F.col("longitude") * 10).alias("x"))
    first = rows.withColumn("first", F.min("pos").over(Window.partitionBy("case_id", "y", "x")))
    hair = F.when(F.col("pos") == F.col("first"), 0.0).otherwise((F.col("pos") % 19 - 9) / F.lit(1e6))
    fixes = first.select("case_id", "pos", (F.col("y") / 10 + hair).alias("latitude"), (F.col("x") / 10 - hair).alias("longitude"), F.lit("LINK").alias("source"))
    return mobile.operator_locations(fixes).select("case_id", "pos")
