"""Golden cases of the flight operators, built here in the shapes the model defines."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flightlens.functions import geo
from flightlens.operators import anomalies, asof, custody, detectors, evidence, geofence, lifecycle, mission, mobile, places, retrieval, sinks, summary, timeline
from flightlens.sources import zones

T0 = datetime(2024, 1, 1, 10, 0, 0)
TELEMETRY = "case_id long, evidence_id string, ingest_seq long, seq long, ts timestamp, latitude double, longitude double, altitude_m double, ground_speed_mps double, battery_pct double"


def points(spark, rows, case=1):
    """rows: (seconds from T0, latitude, longitude, altitude)."""
    return spark.createDataFrame(
        [(case, "e", 0, i, None if s is None else T0 + timedelta(seconds=s), float(a), float(b), float(h), 1.0, 50.0) for i, (s, a, b, h) in enumerate(rows)], TELEMETRY
    )


def test_haversine_and_polygon(spark):
    row = spark.range(1).select(
        geo.haversine_m(F.lit(19.0), F.lit(72.0), F.lit(19.0), F.lit(72.001)).alias("d"),
        *[geo.point_in_polygon(F.lit(a), F.lit(b), F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (0, 10), (10, 10), (10, 0))])).alias(n) for n, a, b in (("inside", 5.0, 5.0), ("outside", 5.0, 15.0))],
        geo.point_in_polygon(F.lit(0.0), F.lit(0.0), F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))).alias("line"),
        geo.dms_to_decimal(F.lit(19), F.lit(7), F.lit(30.0), F.lit("S")).alias("dms"),
        geo.fixed(F.lit(44.25), 1).alias("even"),
        geo.fixed(F.lit(1234.15), 1).alias("binary"),
    ).first()
    assert abs(row.d - 105.13) < 0.1 and row.inside and not row.outside and not row.line
    assert row.dms == -19.125 and row.even == "44.2" and row.binary == f"{1234.15:.1f}"


def brute_inside(lat, lon, zone):
    if zone["zone_type"] == "circle":
        p, q = math.radians(lat), math.radians(zone["center_lat"])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(zone["center_lon"] - lon) / 2) ** 2
        return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) <= zone["radius_meters"]
    ring, odd = zone["coordinates"], False
    for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (b > lon) != (d > lon) and lat < (a - c) * (lon - d) / (b - d + 1e-12) + c:
            odd = not odd
    return odd


def test_grid_join_finds_what_a_theta_join_finds(spark):
    rng = random.Random(1)
    rows = [(i, 18.85 + rng.random() * 0.4, 72.7 + rng.random() * 0.35, 30 + i % 60) for i in range(600)]
    catalog = [r.asDict(recursive=True) for r in zones.zone_catalog(spark).collect()]
    found = {(r.seq, r.zone_id) for r in geofence.geofence_violations(points(spark, rows), zones.zone_catalog(spark)).collect()}
    assert found == {(i, z["zone_id"]) for i, (_, a, b, _) in enumerate(rows) for z in catalog if brute_inside(a, b, z)}
    assert found


def test_violations_have_types_numbers_and_windows(spark):
    ring = [[19.130, 72.910], [19.130, 72.920], [19.140, 72.920], [19.140, 72.910]]
    row = (0, "Z1", "Campus", "polygon", ring, None, None, None, 50.0, None, None, False, "CAMPUS", "YELLOW", "Security", "R")
    later = (1, "Z2", "Later", "circle", None, 19.135, 72.915, 5000.0, None, T0 + timedelta(seconds=2), None, True, "X", "RED", None, "R")
    found = geofence.geofence_violations(points(spark, [(0, 19.135, 72.915, 40), (1, 19.135, 72.915, 60), (2, 19.2, 72.8, 60), (3, 19.135, 72.915, 10)]), spark.createDataFrame([(*row, None), (*later, None)], zones.SCHEMA)).orderBy("violation_id").collect()
    assert [(r.violation_id, r.zone_id, r.violation_type, r.severity) for r in found] == [
        ("VIO-0001", "Z1", "BOUNDARY_ENTRY", "WARNING"), ("VIO-0002", "Z1", "CEILING_EXCEEDED", "WARNING"), ("VIO-0003", "Z1", "BOUNDARY_ENTRY", "WARNING"), ("VIO-0004", "Z2", "BOUNDARY_ENTRY", "CRITICAL")
    ]
    assert found[0].details == "UAV entered restricted airspace 'Campus' [Security] at altitude 40.0m"
    assert found[1].details == "UAV exceeded statutory ceiling (50.0m) inside 'Campus' [Security] at altitude 60.0m"
    assert geofence.geofence_violations(points(spark, []), zones.zone_catalog(spark)).count() == 0


def test_episodes_split_where_the_track_leaves(spark):
    zone = (0, "Z", "C", "circle", None, 19.0, 72.0, 1000.0, None, None, None, True, "X", "RED", None, "R")
    track = [(0, 19, 72, 1), (1, 19, 72, 5), (2, 20, 72, 1), (3, 19, 72, 2)]
    found = geofence.breach_episodes(points(spark, track), spark.createDataFrame([(*zone, None)], zones.SCHEMA)).orderBy("first_place").collect()
    assert [(r.first_place, r.points, r.max_altitude_m, r.duration_sec) for r in found] == [(1, 2, 5.0, 1.0), (4, 1, 2.0, 0.0)]


def test_zone_maintenance(spark):
    catalog = zones.zone_catalog(spark)
    start = catalog.filter(F.col("zone_id").isin(*zones.DEFAULT_IDS))
    everything = zones.load_all(start, catalog)
    assert everything.filter("added").count() == catalog.count() - 1 and everything.count() == catalog.count()
    moved = zones.upsert_zones(catalog, zones.zone_by_id(catalog, "ZONE-AIRPORT-BOM").withColumn("radius_meters", F.lit(1.0)))
    last = moved.orderBy(F.desc("zone_pos")).first()
    assert last.zone_id == "ZONE-AIRPORT-BOM" and last.radius_meters == 1.0 and moved.count() == catalog.count()
    assert catalog.count() == 42 and zones.filter_zones(catalog, "PRISON", zones.REGION).count() == 1 and zones.filter_zones(catalog, "PRISON", "ALL").count() == 3
    assert [r.zone_id for r in zones.search_zones(catalog, "Corrections").collect()] == [] and [r.zone_id for r in zones.search_zones(catalog, "CONTRABAND").collect()] == ["ZONE-PRISON-ARTHUR"]


def test_reversal_gap_jump_and_midair_disarm(spark):
    track = points(spark, [(0, 19, 72, 30), (10, 19, 72, 30), (8, 19, 72, 30), (9, 19.01, 72, 30), (None, 19, 72, 30)])
    events = spark.createDataFrame([(1, 0, 0, T0, "DISARM", 25.0), (1, 0, 1, T0, "DISARM", 1.0)], "case_id long, ingest_seq long, seq long, ts timestamp, event_type string, altitude_m double")
    found = anomalies.anomaly_report(track, events).orderBy("anomaly_id").collect()
    assert [(r.anomaly_id, r.anomaly_type, r.severity) for r in found] == [
        ("ANOM-001", "TIMESTAMP_GAP", "MEDIUM"), ("ANOM-002", "CLOCK_SKEW", "HIGH"), ("ANOM-003", "GPS_DISCORDANCE", "HIGH"), ("ANOM-004", "UNEXPECTED_DISARM", "CRITICAL")
    ]
    assert found[0].ts == T0 and found[1].ts == T0 + timedelta(seconds=8)
    assert found[1].description == "Time reversal detected: sequence time dropped by 2.00s"


def test_order_is_by_place_not_by_partition(spark):
    track = points(spark, [(i, 19 + i / 1e4, 72, i) for i in range(50)])
    mixed = track.orderBy(F.rand(3)).repartition(7)
    assert summary.flight_summary(track).collect() == summary.flight_summary(mixed).collect()
    assert sorted(summary.telemetry_windows(track, 10, 7).collect()) == sorted(summary.telemetry_windows(mixed, 10, 7).collect())


@pytest.mark.parametrize("n", [1, 59, 60, 61, 105, 106, 200])
def test_windows_stop_at_the_end(spark, n):
    starts = []
    for i in range(0, n, 45):
        starts.append((i // 45, min(60, n - i)))
        if i + 60 >= n:
            break
    found = summary.telemetry_windows(points(spark, [(i, 19, 72, i) for i in range(n)])).orderBy("win").collect()
    assert [(r.win, r.samples) for r in found] == starts


def test_stretches_join_up(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, f"e{f}", f, rng.randrange(10**6) * 7 + f, T0 + timedelta(seconds=rng.randrange(1000)) if rng.random() > 0.1 else None, rng.random(), rng.random(), 1.0, 1.0, 1.0) for c in (1, 2) for f in (0, 1, 2) for _ in range(40)]
    track = spark.createDataFrame(rows, TELEMETRY)
    ordered = sorted(rows, key=lambda r: (r[0], r[2], r[3]))
    for stretch, per_file in ((100_000, False), (1_000_000, True), (10**9, False)):
        monkeypatch.setattr(places, "STRETCH", stretch)
        found = {(r.case_id, r.seq): (r.prev_ts, r.prev_latitude) for r in places.with_previous(track, ("ts", "latitude"), per_file).collect()}
        for before, now in zip([None, *ordered], ordered, strict=False):
            known = before is not None and before[0] == now[0] and (not per_file or before[1] == now[1])
            assert found[now[0], now[3]] == ((before[4], before[5]) if known else (None, None))
        numbered = sorted((r.case_id, r.place, r.seq, r.case_rows) for r in places.with_place(track).collect())
        assert numbered == [(r[0], i % 120, r[3], 120) for i, r in enumerate(ordered)]


def test_summary_of_a_case_without_telemetry(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    rows = {r.case_id: r for r in summary.flight_summary(points(spark, [(0, 19, 72, 3), (60, 19, 72.001, 9)]), cases=cases).collect()}
    assert rows[1].duration_sec == 60.0 and rows[1].total_distance_m == 105.14 or abs(rows[1].total_distance_m - 105.14) < 0.1
    assert (rows[2].telemetry_count, rows[2].total_distance_m, rows[2].start_ts) == (0, 0.0, None)


def test_nearest_media_prefers_the_earlier_of_equals(spark):
    track = points(spark, [(0, 1, 1, 1), (10, 2, 2, 2), (20, 3, 3, 3), (20, 4, 4, 4)])
    media = spark.createDataFrame([(1, i, None if s is None else T0 + timedelta(seconds=s), d) for i, (s, d) in enumerate([(5, None), (16, None), (100, None), (None, None), (-500, 600.0), (-1, None), (20, None)])], "case_id long, media_id long, ts timestamp, duration_sec double")
    found = {r.media_id: (r.matched_seq, r.delta_seconds, r.high_confidence) for r in asof.nearest_media(media, track).collect()}
    assert found == {0: (0, 5.0, False), 1: (2, 4.0, False), 2: (2, 80.0, False), 4: (0, 500.0, False), 5: (0, 1.0, True), 6: (2, 0.0, True)}
    overlap = {r.media_id: r.has_overlap for r in asof.media_overlap(media, track).collect()}
    assert overlap == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True}
    assert asof.media_events(asof.media_overlap(media, track)).count() == 5


def test_mission_is_scored_and_marked_as_interrupted(spark):
    plan = spark.createDataFrame([(1, "p", 0, "HOME", 19.0, 72.0, 0.0), (1, "p", 1, "WAYPOINT", 19.0, 72.0, 50.0), (1, "p", 2, "WAYPOINT", 19.001, 72.0, 50.0), (1, "p", 3, "WAYPOINT", 19.01, 72.0, 50.0)], "case_id long, plan_id string, idx int, command string, latitude double, longitude double, altitude_m double")
    compared = mission.mission_compare(plan, points(spark, [(0, 19, 72, 50), (1, 19.001, 72, 50), (2, 19.002, 72, 50)]))
    row = mission.mission_compliance(compared).first()
    assert (row.waypoints_total, row.waypoints_reached, row.compliance_pct, row.interrupted) == (3, 2, 66.7, True)
    assert mission.mission_compliance(mission.mission_compare(plan, points(spark, []))).first().waypoints_reached == 0
    times = [r.ts for r in mission.waypoint_telemetry(plan, "2024-01-01 00:00:00", 15).orderBy("seq").collect()]
    assert times[1] - times[0] == timedelta(seconds=15)


def test_lifecycle_and_timeline_order(spark):
    track = points(spark, [(0, 19, 72, 3), (1, 19, 72, 150), (2, 19, 72, 150)])
    made = lifecycle.synth_lifecycle(track).orderBy("ord").collect()
    assert [r.event_type for r in made] == ["ARM", "TAKEOFF", "ERROR_ALERT", "LANDING", "DISARM"]
    assert made[2].ts == T0 + timedelta(seconds=1) and made[4].ts == T0 + timedelta(seconds=3) and made[4].altitude_m == 0
    own = spark.createDataFrame([(1, "ARM")], "case_id long, event_type string")
    assert "ARM" not in [r.event_type for r in lifecycle.synth_lifecycle(track, own).collect()]
    events = lifecycle.synth_lifecycle(track).withColumns({"ts": F.lit(T0), "ingest_seq": F.lit(0), "seq": F.lit(0), "description": F.lit("d")})
    found = timeline.ordered_timeline(timeline.master_timeline(events)).collect()
    assert [r.event_type for r in found][:2] == ["ARM", "TAKEOFF"] and [r.event_type for r in found][-1] == "DISARM"


def test_hashes_and_manifests(spark):
    files = spark.createDataFrame([("a", bytearray(b"abc")), ("b", bytearray(b"")), ("n", None)], "item_id string, content binary")
    rows = {r.item_id: r for r in evidence.hash_manifest(files, F.col("content")).collect()}
    assert rows["a"].sha256 == hashlib.sha256(b"abc").hexdigest() and rows["a"].md5 == hashlib.md5(b"abc").hexdigest()
    assert rows["a"].sha3_256 == hashlib.sha3_256(b"abc").hexdigest() and rows["a"].byte_count == 3 and rows["n"].sha256 is None
    computed = evidence.hash_manifest(files, F.col("content"), sha3=False)
    expected = computed.withColumn("sha256", F.upper("sha256")).filter("item_id <> 'b'")
    assert {r.item_id: r.is_valid for r in evidence.verify_manifest(expected, computed).collect()} == {"a": True, "b": False, "n": False}


def test_custody_chain_holds_until_an_entry_is_edited(spark):
    key = b"k" * 80
    entries = spark.createDataFrame([(1, i, f"t{i}", "a", "act", f"d{i}", None) for i in range(1, 5)] + [(2, 1, "t", "a", "act", None, "x")], "case_id long, entry_id long, ts_raw string, actor string, action string, details string, evidence_item_id string")
    chain = custody.chain_append(entries, key)
    first = chain.filter("case_id = 1 and entry_id = 1").first()
    assert first.signature == hmac.new(key, f"1|t1|a|act|d1||{custody.GENESIS}".encode(), "sha256").hexdigest()
    assert all(r.valid and r.message is None for r in custody.chain_verify(chain, key).collect())
    edited = chain.withColumn("details", F.when(F.col("entry_id") == 2, "other").otherwise(F.col("details")))
    assert {r.case_id: r.message for r in custody.chain_verify(edited, key).collect()} == {1: "Tampered entry #2: signature mismatch. Integrity compromised.", 2: None}
    cut = custody.chain_verify(chain.filter("entry_id <> 2"), key).filter("case_id = 1").first()
    assert not cut.valid and cut.message.startswith("Broken chain at entry #3")


@pytest.mark.parametrize(
    ("path", "head", "category", "platform"),
    [
        ("x/flight.bin", b"\xa3\x95\x80", "LOGS", "ardupilot"),
        ("x/clip.MP4", b"", "VIDEO_IMAGES", "dji"),
        ("x/photo_media.e01", b"", "VIDEO_IMAGES", "dji"),
        ("x/a.weird", b"\xff\xd8\xff\xe0", "VIDEO_IMAGES", "dji"),
        ("x/a.weird", b"....ftypisom", "VIDEO_IMAGES", "dji"),
        ("x/plan.plan", b'{"fileType": "Plan"', "GCS", "ardupilot"),
        ("x/m.txt", b"QGC WPL 110\n", "GCS", "ardupilot"),
        ("x/m.kml", b"<kml><wpml:a/>", "GCS", "dji"),
        ("x/anafi.json", b'{"run_id": 1, "product_name": "Anafi by parrot"}', "GCS", "parrot"),
        ("x/log.csv", b"timestamp,lat,lon\n", "LOGS", "px4"),
        ("x/bb.txt", b"H Product:Blackbox flight data\n", "LOGS", "betaflight"),
        ("x/cli.txt", b"set nav_x = 1\n", "LOGS", "betaflight"),
        ("x/f.srt", b"GPS(1,2,3)", "LOGS", "dji"),
        ("x/none", b"", "LOGS", "dji"),
    ],
)
def test_classification_and_platforms(spark, path, head, category, platform):
    row = spark.createDataFrame([(path, bytearray(head))], "path string, content binary").withColumn("head", evidence.head_text(F.col("content")))
    found = row.select(evidence.classify(F.col("path"), F.col("head")).alias("c"), evidence.detect_platform(F.col("path"), F.col("head")).alias("p")).first()
    assert (found.c, found.p) == (category, platform)


def test_account_fields_and_operator_places(spark):
    pairs = spark.createDataFrame([(1, 1, "Email", "a@x"), (1, 2, "user_email", "b@x"), (1, 3, "uid", "7"), (1, 4, "uid", "8"), (1, 5, "nick", ""), (1, 6, "phone", "12"), (1, 7, "email", "")], "case_id long, pos long, key string, value string")
    row = mobile.account_fields(pairs).first()
    assert (row.email, row.user_id, row.pilot_name, row.phone) == ("b@x", "7", None, "12")
    fixes = spark.createDataFrame([(1, 1, 10.0, 20.0, "a"), (1, 2, 10.000001, 20.0, "b"), (1, 3, 11.0, 20.0, "c"), (1, 4, 10.0, 20.0, "d")], "case_id long, pos long, latitude double, longitude double, source string")
    assert sorted(r.source for r in mobile.operator_locations(fixes).collect()) == ["a", "c"]


def brute_embedding(text, dims=768):
    vector = [0.0] * dims
    words = text.lower().replace(",", " ").replace("|", " ").replace(":", " ").split()
    for w in words:
        h = int(hashlib.sha256(w.encode()).hexdigest()[:8], 16)
        vector[h % dims] += 1.0 if (h >> 16) % 2 == 0 else -1.0
    if words:
        for i in range(len(text) - 2):
            vector[(int(hashlib.md5(text[i : i + 3].lower().encode()).hexdigest()[:8], 16) >> 4) % dims] += 0.5
    norm = math.sqrt(sum(v * v for v in vector))
    return [v / norm if norm > 1e-6 else v for v in vector]


def test_embeddings_and_top_k(spark):
    texts = ["geofence breach, zone: Z1 | critical", "battery low", "", "x", "clock skew detected in telemetry", None]
    rows = retrieval.hash_embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id").collect()
    for r in rows:
        assert max(abs(a - b) for a, b in zip(r.embedding, brute_embedding(r.text or ""), strict=True)) < 1e-5
    chunks = spark.createDataFrame([(r.id, 1, list(r.embedding), r.text) for r in rows], "chunk_id long, case_id long, embedding array<float>, text string")
    asked = retrieval.hash_embed(spark.createDataFrame([(9, 1, "zone breach critical")], "query_id long, case_id long, text string")).select("query_id", "case_id", F.col("embedding").alias("query_vector"))
    best = retrieval.top_k(asked, chunks, k=2).filter("rank = 1").first()
    assert best.chunk_id == 0
    assert retrieval.top_k(asked, chunks, k=2, where=F.col("chunk_id") > 0, per_case=False).filter("chunk_id = 0").count() == 0
    assert retrieval.numbered_sources(retrieval.top_k(asked, chunks, k=1), chunks).first().context == f"[1] {texts[0]}"


def test_scores_and_exports(spark):
    found = spark.createDataFrame([("s", 1, 1), ("s", 1, 0), ("s", 0, 1), ("s", 0, 0), ("t", 0, 0)], "suite string, predicted int, actual int")
    rows = {r.suite: r for r in detectors.detector_quality(found, ["suite"]).collect()}
    assert (rows["s"].precision, rows["s"].recall, rows["s"].f1, rows["t"].f1, rows["t"].accuracy) == (0.5, 0.5, 0.5, 0.0, 1.0)
    scores = {r.suite: r.score_pct for r in detectors.suite_score(found.select("suite", (F.col("predicted") == F.col("actual")).alias("passed"))).collect()}
    assert scores == {"s": 50.0, "t": 100.0, None: 60.0}
    import json

    track = points(spark, [(0, 19, 72, 3), (1, 19.5, 72.5, 4)])
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    docs = {r.case_id: json.loads(r.geojson) for r in sinks.to_geojson(track, cases).collect()}
    assert [f["geometry"]["type"] for f in docs[1]["features"]] == ["LineString", "Point", "Point"] and docs[1]["features"][0]["geometry"]["coordinates"][0] == [72.0, 19.0, 3.0]
    assert docs[2] == {"type": "FeatureCollection", "features": []}
    assert "72.0,19.0,3.0\n72.5,19.5,4.0" in sinks.to_kml(track).first().kml
    blocks = sinks.to_srt(asof.resample(track, 1000)).orderBy("slot").collect()
    assert blocks[1].srt.startswith("2\n00:00:01,000 --> 00:00:02,000\n[latitude: 19.5000000]")
    whole = json.loads(sinks.case_json(summary.flight_summary(track), path=track.select("case_id", "seq", "altitude_m")).first().json)
    assert whole["summary"]["telemetry_count"] == 2 and [p["altitude_m"] for p in whole["path"]] == [3.0, 4.0]


def test_lists_are_cut_into_stretches_without_a_difference(spark, monkeypatch):
    """Numbers, previous rows and last values over stretches equal those of a plain loop, null keys included."""
    monkeypatch.setattr(places, "STRETCH", 4)
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), f, s, rng.choice([None, None, rng.random()])) for f in range(3) for s in range(40) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "case_id long, ingest_seq long, seq long, v double")
    got = places.numbered(df, "n", ["case_id"], places.in_list(), ["seq"], "of")
    got = places.previous(got, F.struct("v", "seq"), "before", ["case_id"], places.in_list(), "seq")
    got = places.with_last(got, {"last": F.col("v")}, ["case_id"], places.in_list(), ["seq"])
    got = places.with_last(got, {"ahead": F.col("v")}, ["case_id"], places.in_list(), ["seq"], descending=True)
    want = []
    for case in (1, 2, None):
        own = sorted(r[1:] for r in rows if r[0] == case)
        values = [v for _, _, v in own]
        for i, (f, s, v) in enumerate(own):
            last = next((x for x in reversed(values[: i + 1]) if x is not None), None)
            ahead = next((x for x in values[i:] if x is not None), None)
            want.append((case, f, s, v, i + 1, len(own), None if i == 0 else (own[i - 1][2], own[i - 1][1]), last, ahead))
    found = [(r.case_id, r.ingest_seq, r.seq, r.v, r.n, r.of, None if r.before is None else tuple(r.before), r["last"], r.ahead) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_no_window_takes_a_whole_case(spark):
    """Windows over rows are cut by stretch; those over a case alone read one row per stretch, from an aggregate."""
    track = points(spark, [(i, 19 + i / 1e4, 72, 30) for i in range(50)])
    media = spark.createDataFrame([(1, 1, T0, 30.0)], "case_id long, media_id long, ts timestamp, duration_sec double")
    for df in (asof.nearest_media(media, track), asof.carry_forward(track, ["altitude_m"]), asof.arm_edges(track, F.col("altitude_m") > 1), anomalies.anomaly_report(track), geofence.geofence_violations(track, zones.zone_catalog(spark))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        cut = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
        whole = [line for line in cut if "_stretch" not in line.rsplit("], [", 2)[1]]
        assert cut and len(whole) < len(cut)
        assert all(re.search("_n|_total|_last|_v_|_c_|_before|_carried", line) for line in whole), whole


def test_track_files_hold_what_the_rows_hold(spark, tmp_path):
    track = points(spark, [(i, 19 + i / 1e4, 72, 30 + i) for i in range(12)])
    sinks.write_kml(track, f"file://{tmp_path}/kml")
    sinks.write_geojson(track, f"file://{tmp_path}/json")
    (kml,) = (tmp_path / "kml").glob("case_id=*/*.txt")
    (geo,) = (tmp_path / "json").glob("case_id=*/*.txt")
    assert kml.read_text() == sinks.to_kml(track).first().kml + "\n"
    assert json.loads(geo.read_text()) == json.loads(sinks.to_geojson(track).first().geojson)


def test_top_k_ranks_odd_vectors_as_scores_of_all_pairs_do(spark):
    """Null, short, zero and non-finite vectors, many ties, and ids as texts: against every pair's cosine."""
    rng = random.Random(5)
    some = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]
    odd = [None, [], [1.0, None, 2.0, 3.0], [0.0] * 4, [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 0.0]]
    chunk = "chunk_id string, case_id long, embedding array<double>"
    chunks = spark.createDataFrame([(f"c{i:04d}", rng.choice([1, 2, None]), some()) for i in range(3_000)] + [(f"o{i}", 1 + i % 2, v) for i, v in enumerate(odd)], chunk).repartition(3)
    plain = spark.createDataFrame([(f"s{i}", 1, v) for i, v in enumerate([None, [0.0] * 4, [1.0, 2.0], [1.0, 0.5, 0.25, 0.1]])], chunk)
    queries = spark.createDataFrame([(i, rng.choice([1, 2]), some()) for i in range(20)] + [(100 + i, 1, v) for i, v in enumerate(odd[:5])], "query_id long, case_id long, query_vector array<double>")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    for rows in (chunks, plain):
        for per_case in (True, False):
            pairs = rows.select("chunk_id", F.col("case_id").alias("of"), "embedding").join(queries, (F.col("of") == F.col("case_id")) if per_case else F.lit(True))
            lengths = norm(F.col("query_vector")) * norm(F.col("embedding"))
            dot = F.aggregate(F.zip_with("query_vector", "embedding", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
            scored = pairs.select("query_id", "chunk_id", F.round(F.when(lengths > 0, dot / lengths).otherwise(0.0), 4).alias("score"))
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
            want = scored.withColumn("rank", rank).filter("rank <= 7").collect()
            found = retrieval.top_k(queries, rows, 7, per_case=per_case, block=11).collect()
            assert sorted(map(str, found)) == sorted(map(str, want))


def test_long_texts_are_embedded_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdé,| 😀") for _ in range(rng.randrange(200))) for _ in range(40)] + ["", None, " ", "ab"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words, trigrams = retrieval._Words(768), retrieval._Trigrams(768)
    whole = retrieval._embedded([t or "" for t in texts], 768, words, trigrams)
    monkeypatch.setattr(retrieval, "SLICE_CHARS", 7)
    assert (retrieval._embedded([t or "" for t in texts], 768, words, retrieval._Trigrams(768, 20)) == whole).all()
    found = retrieval.hash_embed(frame).orderBy("id").collect()
    assert [list(r.embedding) for r in found] == whole.tolist()
    assert max(abs(a - b) for r, t in zip(found, texts, strict=True) for a, b in zip(r.embedding, brute_embedding(t or ""), strict=True)) < 1e-5
