"""Streams equal their batch forms; the registry routes files; registered queries equal their oracles."""

from __future__ import annotations

import os
import struct
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flightlens.operators import anomalies
from flightlens.plans import catalog, files, more, views  # noqa: F401
from flightlens.sources import registry
from flightlens.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(stream, mode="append"):
    return jobs.run_once(stream, mode)


def test_stream_of_gaps_equals_batch(spark, sf_dir):
    found = run(jobs.stream_gaps(jobs.arriving_telemetry(spark, sf_dir), 3600.0, 5.0))
    batch = anomalies.anomaly_candidates(views.telemetry(spark, sf_dir), gap_seconds=3600.0, jump_mps=5.0)
    key = lambda df: sorted((r.case_id, r.seq, r.anomaly_type, r.ts) for r in df.collect())
    assert key(found) == key(batch) and found.count() > 100


def arriving(spark, tmp_path, batches, schema):
    """Rows that arrive in several files, one a trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for f in os.listdir(tmp_path / "in"):
            if f.endswith(".parquet") and not f.startswith("b"):
                os.rename(tmp_path / "in" / f, tmp_path / "in" / f"b{i}-{f}")
                os.utime(tmp_path / "in" / f"b{i}-{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


T = datetime(2024, 1, 1)
POINT = "case_id long, seq long, ts timestamp, latitude double, longitude double, altitude_m double, ground_speed_mps double"


def at(*seconds, start=0):
    return [(1, start + i, T + timedelta(seconds=s), 19.0, 72.0, float(s), 1.0) for i, s in enumerate(seconds)]


def test_gaps_are_seen_across_batches(spark, tmp_path):
    stream = arriving(spark, tmp_path, [at(0, 1), at(100, 99, start=2), at(100, start=4)], POINT)
    found = run(jobs.stream_gaps(stream)).orderBy("seq").collect()
    assert [(r.seq, r.anomaly_type, r.gap_sec) for r in found] == [(2, "TIMESTAMP_GAP", 99.0), (3, "CLOCK_SKEW", -1.0)]


def test_windows_and_sessions_close_behind_the_watermark(spark, tmp_path):
    points = [at(0, 2, 4, 50, 52), at(5000, start=9)]
    windows = run(jobs.stream_windows(arriving(spark, tmp_path / "w", points, POINT))).orderBy("start_ts").collect()
    assert sum(r.samples for r in windows if r.start_ts == T) == 5
    flights = run(jobs.stream_flights(arriving(spark, tmp_path / "f", points, POINT))).orderBy("start_ts").collect()
    assert [(r.points, (r.end_ts - r.start_ts).total_seconds()) for r in flights] == [(3, 9.0), (2, 7.0)]


def test_media_meet_points_within_the_interval(spark, tmp_path):
    track = arriving(spark, tmp_path / "t", [at(0, 30, 200), at(5000, start=9)], POINT)
    media = arriving(spark, tmp_path / "m", [[(1, 7, T + timedelta(seconds=40))], [(1, 8, T + timedelta(seconds=5000))]], "case_id long, media_id long, ts timestamp")
    found = run(jobs.stream_media_match(media, track)).collect()
    assert sorted((r.media_id, r.seq) for r in found) == [(7, 0), (7, 1), (8, 9)]


def test_media_meet_points_by_stretches_of_time(spark, tmp_path):
    """A month of points in one case: rows meet those of their stretch alone, and lose none on its borders."""
    track = [(1, i, T + timedelta(seconds=100 * i), 19.0, 72.0, 1.0, 1.0) for i in range(26_000)]
    media = [(1, i, T + timedelta(seconds=137 * i + 0.5), (None, 30.0, 500.25, 9_000.0)[i % 4]) for i in range(4_000)]
    stream = jobs.stream_media_match(arriving(spark, tmp_path / "m", [media], "case_id long, media_id long, ts timestamp, duration_sec double"), arriving(spark, tmp_path / "t", [track], POINT), delay="1000 days")
    assert "bucket" in stream._jdf.queryExecution().analyzed().toString().split("Join Inner", 1)[1].split("\n")[0]
    want = set()
    for _, i, ts, duration in media:
        low, high = (-15, min(duration, 7_200) + 15) if duration else (-60, 60)
        at = (ts - T).total_seconds()
        want |= {(i, k) for k in range(max(0, int((at + low) // 100)), min(26_000, int((at + high) // 100) + 1)) if low <= 100 * k - at <= high}
    assert sorted((r.media_id, r.seq) for r in run(stream).collect()) == sorted(want)


def test_blocks_of_media_and_points_give_the_same_pairs(spark, tmp_path, monkeypatch):
    """Packs of several batches, cut small and given early, hold each pair once; rows without a time or case meet nothing."""
    monkeypatch.setattr(jobs, "PACK_ROWS", 3)
    monkeypatch.setattr(jobs, "HELD_ROWS", 50)
    track = [[(1 + i % 2, i, T + timedelta(seconds=7 * (i % 400)), 19.0, 72.0, 1.0, 1.0) for i in range(k, 1_200, 2)] for k in range(2)]
    track[0] += [(1, 9_000, None, 19.0, 72.0, 1.0, 1.0), (None, 9_001, T, 19.0, 72.0, 1.0, 1.0)]
    media = [[(1 + i % 2, i, T + timedelta(seconds=11 * i + 0.5), (None, 30.0, 500.25, 9_000.0)[i // 2 % 4]) for i in range(k, 200, 2)] for k in range(2)]
    media[1] += [(1, 9_000, None, None), (None, 9_001, T, 30.0)]
    kind = "case_id long, media_id long, ts timestamp, duration_sec double"
    blocks = jobs.stream_media_blocks(arriving(spark, tmp_path / "m", media, kind), arriving(spark, tmp_path / "t", track, POINT), longest=3_600)
    found = jobs.media_pairs(run(blocks), longest=3_600).collect()
    byrow = run(jobs.stream_media_match(arriving(spark, tmp_path / "m2", media, kind), arriving(spark, tmp_path / "t2", track, POINT), longest=3_600, delay="1000 days")).collect()
    assert len(found) > 20_000 and sorted(found) == sorted(byrow)


def test_a_table_of_media_is_matched_in_packs(spark, tmp_path, monkeypatch):
    """What the stream keeps and writes doesn't grow with the pairs."""
    pq.write_table(pa.table({
        "event_id": pa.array(range(6_000), pa.int64()), "ts": pa.array([T + timedelta(seconds=i % 300) for i in range(6_000)], pa.timestamp("us")), "user_id": pa.array([3] * 6_000, pa.int64()),
        "event_type": ["purchase" if i % 3 == 0 else "click" for i in range(6_000)], "value": [1.5] * 6_000, "props": ['{"k": 1}'] * 6_000,
    }), tmp_path / "events.parquet")
    sunk, run_once = [], jobs.run_once
    monkeypatch.setattr(jobs, "run_once", lambda *a: sunk.append(run_once(*a)) or sunk[-1])
    pairs = jobs.run_media_match(spark, str(tmp_path), 600).count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert pairs == con.execute(f"SELECT count(*) FROM ({catalog.ORACLE_SQL['stream_media_match']})").fetchone()[0] > 1_000_000
    assert sunk[0].count() < 100


def test_landed_radio_logs_become_positions(spark, tmp_path):
    position = struct.pack("<IiiiihhhH", 1, 191334000, 729133000, 99000, 15500, 300, 400, 0, 0)
    stamp = (1_700_000_000_000_000).to_bytes(8, "big")
    (tmp_path / "a.tlog").write_bytes(stamp + bytes([0xFE, len(position), 0, 1, 1, 33]) + position + bytes(2) + bytes(16))
    found = run(jobs.stream_frames(spark, f"file://{tmp_path}")).collect()
    assert [(r.latitude, r.altitude_m) for r in found] == [(19.1334, 15.5)]


def test_files_are_routed_and_read(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHOME 2024-01-01 10:00:00 GPS [latitude: 19.1] [longitude: 72.9]\n")
    (tmp_path / "b.csv").write_text("timestamp,lat,lon,alt\n1,19.2,72.8,5\n")
    (tmp_path / "c.txt").write_text("H Product:Blackbox\nG,1,12,19.3,72.7,5.0,1.2\n")
    (tmp_path / "d.unknown").write_text("x")
    found = registry.Registry().read_all(spark, f"file://{tmp_path}")
    assert {(r.file[-5:], r.latitude, r.source_channel) for r in found.collect()} == {("a.srt", 19.1, "DJI_SRT_STREAM"), ("b.csv", 19.2, "PX4_CSV_STREAM"), ("c.txt", 19.3, "BETAFLIGHT_BLACKBOX_GPS")}
    own = registry.Registry()
    own.register(registry.Reader("last", "any", (), lambda s, p: None, lambda path, head: F.lit(True)))
    row = spark.createDataFrame([("x/d.unknown", "x")], "path string, head string").select(own.route(F.col("path"), F.col("head")).alias("r")).first()
    assert row.r == "last" and own.table(spark).count() == len(own.readers)
    assert registry.Registry().read_all(spark, f"file://{tmp_path}/d.unknown").count() == 0


def test_a_repeated_ingest_adds_nothing(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "path string, sha256 string")
    known = spark.createDataFrame([("2",)], "sha256 string")
    assert registry.new_evidence(files, known).count() == 1


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def table_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype({c: "float64" for c in frame.columns if pd.api.types.is_numeric_dtype(frame[c]) and not pd.api.types.is_bool_dtype(frame[c])})
    columns = [frame[c].astype("datetime64[us]").astype(str) if str(frame[c].dtype).startswith("datetime") else [None if v is None or v != v else v for v in frame[c]] for c in frame.columns]
    return sorted(zip(*columns, strict=True), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table_of(got) == table_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
