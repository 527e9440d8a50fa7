"""Jobs end to end on small cases."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from flightlens.operators import custody, jobs, mission, mobile, retrieval
from flightlens.plans import views
from flightlens.sources import zones


def test_manifest_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.plan").write_text('{"fileType": "Plan"}')
    (tmp_path / "sub" / "b.bin").write_bytes(b"\xa3\x95\x80")
    items, totals = jobs.manifest(spark, f"file://{tmp_path}", 7)
    assert sorted((r.category, r.platform, r.byte_count) for r in items.collect()) == [("GCS", "ardupilot", 20), ("LOGS", "ardupilot", 3)]
    assert tuple(totals.first()) == (7, 2, 23)


def test_media_times_in_order(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, at, "2020:01:01 00:00:00", None, None), (2, None, "2024:01:01 00:00:00", None, None), (3, None, "bad", "2024-01-01T00:00:00Z", None), (4, None, None, None, at), (5, None, None, None, None)]
    media = spark.createDataFrame(rows, "media_id long, container_ts timestamp, tag_date string, client_ts string, modified_ts timestamp")
    found = {r.media_id: (r.ts, r.timestamp_source) for r in jobs.media_timestamp(media).collect()}
    assert found == {1: (at, "CONTAINER"), 2: (at, "TAG"), 3: (at, "CLIENT"), 4: (at, "FILE"), 5: (None, None)}


def test_case_from_tables_to_report(spark, sf_dir, tmp_path):
    rows, events = views.telemetry(spark, sf_dir), views.events(spark, sf_dir)
    found = jobs.analyze(rows, events, zones.zone_catalog(spark))
    jobs.save({n: found[n].drop("place") for n in ("summary", "anomalies", "violations")}, f"file://{tmp_path}/vault")
    back = jobs.restore(spark, f"file://{tmp_path}/vault", ["summary", "anomalies"])
    assert back["summary"].count() == 10 and back["anomalies"].count() == found["anomalies"].count()
    chain = custody.chain_append(views.custody(spark, sf_dir), b"key")
    text = jobs.case_report(found, views.waypoints(spark, sf_dir), custody_log=chain, key=b"key").filter("case_id = 1").first().json
    report = json.loads(text)
    assert report["summary"]["telemetry_count"] > 0 and len(report["anomalies"]) > 0 and report["custody"][0]["valid"]


def test_index_and_retrieval(spark, sf_dir, tmp_path):
    events = views.events(spark, sf_dir).filter("seq < 200")
    corpus = spark.createDataFrame([("r1", "Ceilings", "Authority", "Below 120 metres")], "id string, title string, authority string, text string")
    jobs.ingest_case([retrieval.chunk_events(events), retrieval.chunk_regulations(corpus, events)], f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, 3, "REGULATION_STANDARD Ceilings Authority Below 120 metres")], "query_id long, case_id long, text string")
    context = jobs.retrieve(spark, f"file://{tmp_path}/index", asked, k=3).first().context
    assert context.startswith("[1] [REGULATION_STANDARD] Ceilings") and "\n[2] [FLIGHT_EVENT]" in context
    only = jobs.retrieve(spark, f"file://{tmp_path}/index", asked, k=3, where=F.col("chunk_type") == "flight_event").first().context
    assert "REGULATION" not in only
    before = retrieval.chunk_count(spark.read.parquet(f"file://{tmp_path}/index")).count()
    jobs.ingest_case([retrieval.chunk_events(events.filter("case_id = 3"))], f"file://{tmp_path}/index")
    assert retrieval.chunk_count(spark.read.parquet(f"file://{tmp_path}/index")).count() == before


def test_chunk_texts(spark):
    items = spark.createDataFrame([(1, "i", "p/x.bin", None, "LOGS", 5, "ab")], "case_id long, item_id string, path string, platform string, category string, byte_count long, sha256 string")
    assert retrieval.chunk_evidence(items).first().text == "[EVIDENCE_ITEM] File: p/x.bin (Item ID: i) | Platform: UNKNOWN | Category: LOGS | Size: 5 bytes | SHA-256: ab"
    media = spark.createDataFrame([(1, 2, "VIDEO", "c.mp4", None, False, None, None, None)], "case_id long, media_id long, media_type string, file_name string, ts timestamp, has_overlap boolean, latitude double, longitude double, altitude_m double")
    assert retrieval.chunk_media(media).first().text == "[MEDIA_RECORD] Type: VIDEO | File: c.mp4 | Capture Timestamp: UNKNOWN | Telemetry Overlap: False | Geo-Coordinates: spatial match=PENDING"
    plan = spark.createDataFrame([(1, "p", 1, "WAYPOINT", 19.0, 72.0, 5.0), (1, "p", 2, "LAND", 19.0, 72.001, 5.0)], "case_id long, plan_id string, idx int, command string, latitude double, longitude double, altitude_m double")
    metrics = mission.plan_metrics(plan).withColumn("gcs_name", F.lit("G"))
    assert retrieval.chunk_plans(metrics).first().text == "[MISSION_PLAN] Plan ID: p | Target GCS: G | Waypoints Count: 2 | Total Planned Distance: 105.1m | Max Altitude: 5.0m"
    assert retrieval.chunk_stations(mission.overview(plan)).first().text == "[GCS_ANALYSIS] Mission Plans: 1 | Commands Issued: 2"
    fixes = spark.createDataFrame([(1, 1, 10.0, 20.0, "RC")], "case_id long, pos long, latitude double, longitude double, source string")
    assert retrieval.chunk_operators(fixes, mobile=True).first().text == "[MOBILE_OPERATOR_FIX] Source: RC | Coordinates: lat=10.000000, lon=20.000000"
    files = spark.createDataFrame([(1, "App", "LOG", "a.txt", None, 3), (1, "App", "HARDWARE", "sn", "X1", None)], "case_id long, app_name string, kind string, name string, value string, points long")
    catalog = spark.createDataFrame([("app", "x.y", "DJI")], "app_name string, package_id string, platform string")
    artifacts = mobile.with_app_catalog(mobile.mobile_artifacts(files), catalog)
    assert retrieval.chunk_apps(artifacts).first().text == "[MOBILE_APP_ARTIFACT] App: App (x.y) | Platform: DJI | Paired Hardware: sn=X1 | Flight Logs Cached: 1"
    owned = artifacts.withColumns({"package_id": F.lit(None).cast("string"), "pilot_account": F.create_map(F.lit("email"), F.lit("a@b"), F.lit("phone"), F.lit(""))})
    assert retrieval.chunk_apps(owned).first().text == "[MOBILE_APP_ARTIFACT] App: App (unknown package) | Platform: DJI | Pilot Account: email=a@b | Paired Hardware: sn=X1 | Flight Logs Cached: 1"
    station = mission.overview(plan).withColumns({"station": F.lit("QGC"), "controller": F.lit("PX4"), "artifacts": F.lit(3)})
    assert retrieval.chunk_stations(station).first().text == "[GCS_ANALYSIS] Ground Control Station: QGC | Flight Controller: PX4 | Artifacts Found: 3 files | Mission Plans: 1 | Commands Issued: 2"
    filed = metrics.withColumns({"file_name": F.lit("a.plan"), "geofence_included": F.lit(True)})
    assert retrieval.chunk_plans(filed).first().text == "[MISSION_PLAN] Plan ID: p | Target GCS: G | File: a.plan | Waypoints Count: 2 | Total Planned Distance: 105.1m | Max Altitude: 5.0m | Geofence Included: True"
    full = fixes.withColumns({"altitude_m": F.lit(7.25), "ts": F.lit("2024-01-02 03:04:05").cast("timestamp"), "accuracy_m": F.lit(None).cast("double"), "description": F.lit("home")})
    assert retrieval.chunk_operators(full).first().text == "[OPERATOR_LOCATION] Source: RC | Coordinates: lat=10.000000, lon=20.000000, alt=7.2m | Timestamp (UTC): 2024-01-02T03:04:05Z | Accuracy: 0.0m | Description: home"
    assert retrieval.chunk_app_overview(mobile.mobile_overview(artifacts)).first().text == "[MOBILE_COMPANION] Companion Apps Detected: App | Platforms: DJI | Total Flight Records: 3"
    assert mobile.merge_artifacts(artifacts, artifacts).count() == 1


def test_file_metadata(spark):
    track = spark.createDataFrame([("f", datetime(2024, 1, 1), 5.0)], "file string, ts timestamp, altitude_m double")
    events = spark.createDataFrame([("f", "ARM"), ("g", "ARM")], "file string, event_type string")
    assert {r.file: (r.points, r.events) for r in jobs.file_metadata(track, events).collect()} == {"f": (1, 1), "g": (0, 1)}
