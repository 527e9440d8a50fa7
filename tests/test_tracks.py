"""Sampled tracks, nearest points, thinned positions and gaps against plain loops."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flightlens.operators import asof, detectors, evidence, mission, mobile, places, sinks
from flightlens.sources import binary
from flightlens.streaming import jobs

T = datetime(2024, 5, 1, 10)
MESSAGE = "case_id long, ingest_seq long, seq long, ts timestamp, latitude double, longitude double, altitude_m double, roll_deg double, pitch_deg double, yaw_deg double"


def messages(rng, n):
    rows, ms = [], 0
    for i in range(n):
        ms += rng.choice([0, 10, 200, 400, 900, 1000, 1700, 9000 if rng.random() < 0.2 else 100])
        fix = rng.random() < 0.5
        ts = None if rng.random() < 0.05 else T + timedelta(milliseconds=ms)
        rows.append((rng.randrange(2), 0, i, ts, *([i * 0.001, 70 + i * 0.001, float(i)] if fix else [None] * 3), *([None] * 3 if fix else [i % 90 * 1.0, -1.0 * i, i % 360 * 1.0])))
    return rows


def emitted(rows, step):
    """The sampler as a loop over messages."""
    out = []
    for case in {r[0] for r in rows}:
        begun, due, number, last = None, 0, 0, [None] * 6
        for r in [r for r in rows if r[0] == case and r[3] is not None]:
            last = [b if b is not None else a for a, b in zip(last, r[4:], strict=True)]
            now = (r[3] - T) // timedelta(milliseconds=1)
            if begun is None:
                begun = due = now
            if now >= due:
                number += 1
                out.append((case, number, due - begun, r[3], *last))
                due += step
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_emissions_equal_a_loop_over_messages(spark, monkeypatch, seed):
    monkeypatch.setattr(places, "STRETCH_SECONDS", 7)
    rows = messages(random.Random(seed), 150)
    found = asof.emissions(spark.createDataFrame(rows, MESSAGE), 1000)
    want = emitted(rows, 1000)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert any(w[2] < (w[3] - T) // timedelta(milliseconds=1) - 3000 for w in want)  # some lag behind a gap
    block = sinks.emissions_to_srt(found).filter("case_id = 0 and number = 2").first().srt
    assert block.startswith("2\n00:00:01,000 --> 00:00:02,000\n[latitude: ") and "m] [roll: " in block


def plan_and_points(rng, points):
    track = [(c, 0, i, 19 + rng.gauss(0, 0.01), 72 + rng.gauss(0, 0.01)) for i in range(points) for c in (1, 2)] + [(1, 0, 10**6, None, 72.0), (1, 0, 10**6 + 1, -33.0, 179.999)]
    plan = [(rng.choice([1, 2, 3]), 1, i, "WAYPOINT", *rng.choice([(19 + rng.gauss(0, 0.01), 72 + rng.gauss(0, 0.01)), (rng.uniform(-90, 90), rng.uniform(-180, 180)), (-33.0, -179.999), (19.0, 72.0)]), 5.0) for i in range(60)]
    return plan, track


PLAN, TRACK = "case_id long, plan_id long, idx long, command string, latitude double, longitude double, altitude_m double", "case_id long, ingest_seq long, seq long, latitude double, longitude double"


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_nearest_points_equal_brute_force(spark):
    plan, track = plan_and_points(random.Random(1), 400)
    found = {(r.case_id, r.idx): r.distance_m for r in mission.mission_compare(spark.createDataFrame(plan, PLAN), spark.createDataFrame(track, TRACK)).collect()}
    for case, _, idx, _, lat, lon, _ in plan:
        own = [metres(lat, lon, r[3], r[4]) for r in track if r[0] == case and r[3] is not None]
        assert found[case, idx] == (pytest.approx(min(own), rel=1e-9, abs=1e-6) if own else None)


def test_waypoints_meet_the_points_near_them_alone(spark):
    sizes = []
    for points in (1_000, 8_000):
        plan, track = plan_and_points(random.Random(2), points)
        on_track = spark.createDataFrame([p for p in plan if abs(p[4] - 19) < 0.1], PLAN)
        rows = spark.createDataFrame(track, TRACK).filter("latitude is not null")
        cells = mission.near_cells(on_track.select("case_id", "plan_id", "idx", "latitude", "longitude"), mission.pyramid(rows))
        placed = rows.select("case_id", mission._cell(F.col("latitude"), 0).alias("cy"), mission._cell(F.col("longitude"), 0).alias("cx"))
        sizes.append(cells.join(placed, ["case_id", "cy", "cx"]).count() / (on_track.filter("case_id < 3").count() * points))
    assert sizes[0] < 0.05 and sizes[1] < 0.05


def thinned(rows):
    kept = []
    for case, pos, lat, lon, source in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        if not any(k[0] == case and abs(k[2] - lat) < 1e-5 and abs(k[3] - lon) < 1e-5 for k in kept):
            kept.append((case, pos, lat, lon, source))
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_thinning_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), i, 19 + rng.randrange(30) * 4e-6, -72 + rng.randrange(6) * 7e-6, f"s{i % 3}") for i in range(120)]
    rows += [(0, 1_000 + i, 20 + i * 6e-6, 10.0, "walk") for i in range(12)]
    fixes = spark.createDataFrame([*rows, (0, 5, None, 1.0, "x"), (0, None, 1.0, 1.0, "x")], "case_id long, pos long, latitude double, longitude double, source string")
    assert sorted(map(tuple, mobile.operator_locations(fixes).collect())) == sorted(thinned(rows))
    assert mobile.operator_locations(fixes.limit(0)).collect() == []


def test_media_of_different_cases_may_share_an_id(spark):
    track = spark.createDataFrame([(c, 0, i, T + timedelta(seconds=60 * i), 10.0 * c + i, 1.0, 5.0) for c in (1, 2) for i in range(3)], "case_id long, ingest_seq long, seq long, ts timestamp, latitude double, longitude double, altitude_m double")
    media = spark.createDataFrame([(c, 7, T + timedelta(seconds=61), None, 0.0, 0.0, 0.0) for c in (1, 2)], "case_id long, media_id long, ts timestamp, duration_sec double, tag_latitude double, tag_longitude double, tag_altitude_m double")
    overlap = asof.media_overlap(media, track)
    assert sorted((r.case_id, r.latitude) for r in overlap.collect()) == [(1, 11.0), (2, 21.0)]
    assert sorted((r.case_id, r.latitude) for r in asof.media_capture(media, overlap).collect()) == [(1, 11.0), (2, 21.0)]


def test_a_manifest_that_differs_in_sha3_alone_is_not_valid(spark):
    manifest = "item_id long, sha256 string, md5 string, byte_count long, sha3_256 string"
    made, given = [(1, "aa", "bb", 3, "cc"), (2, "aa", "bb", 3, "cc")], [(1, "AA", "BB", 3, "CC"), (2, "aa", "bb", 3, "cd")]
    found = evidence.verify_manifest(spark.createDataFrame(given, manifest), spark.createDataFrame(made, manifest)).orderBy("item_id").collect()
    assert [(r.sha3_256_match, r.is_valid) for r in found] == [(True, True), (False, False)]


def test_rows_without_a_time_or_position_have_no_gap(spark, tmp_path):
    rows = [(1, 0, T, 1.0, 1.0), (1, 1, None, 1.0, 1.0), (1, 2, T + timedelta(seconds=100), 2.0, 1.0), (1, 3, T + timedelta(seconds=101), None, 1.0), (1, 4, T + timedelta(seconds=102), 2.0, 1.0), (1, 5, T + timedelta(seconds=110), 2.0, 1.0)]
    spark.createDataFrame(rows, "case_id long, seq long, ts timestamp, latitude double, longitude double").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("case_id long, seq long, ts timestamp, latitude double, longitude double").parquet(f"file://{tmp_path}/in")
    assert [(r.seq, r.anomaly_type, r.gap_sec) for r in jobs.run_once(jobs.stream_gaps(stream)).collect()] == [(5, "TIMESTAMP_GAP", 8.0)]


def test_sha3_has_the_published_digests(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"")), (3, None)], "item_id long, content binary")
    found = {r.item_id: r.sha3_256 for r in evidence.hash_manifest(rows, F.col("content")).collect()}
    assert found == {1: "3a985da74fe225b2045c172d6bd390bd855f086e3e9d525b46bfe24511431532", 2: "a7ffc6f8bf1ed76651c14756a061d662f580ff4de43b49fa82d80a4b80f8434a", 3: None}


def test_the_mean_over_suites_counts_each_suite_once(spark):
    checks = spark.createDataFrame([("a", True), ("a", False), ("a", False), ("b", True), (None, True)], "suite string, passed boolean")
    assert tuple(detectors.suites_overview(checks).first()) == (3, 2, 77.8)
    assert tuple(detectors.suites_overview(checks.limit(0)).first()) == (0, 0, 0.0)


def test_heads_of_files_are_read_alone(spark, tmp_path):
    for name, data in (("a.bin", b"\xa3\x95" + b"x" * 9_000), ("b.txt", b"short")):
        (tmp_path / name).write_bytes(data)
    found = {r.path[-5:]: (r.length, bytes(r.head)) for r in binary.heads(spark, f"file://{tmp_path}", 10).collect()}
    assert found == {"a.bin": (9_002, b"\xa3\x95" + b"x" * 8), "b.txt": (5, b"short")}
