"""Logs that grow, state that is evicted, and whole exports."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import random
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from flightlens.operators import export, retrieval, summary
from flightlens.plans import binary_logs, exports
from flightlens.session import forget, shared_dir, stored
from flightlens.sources import binary, ranges
from flightlens.streaming import frames, jobs
from tests.test_binary_ranges import radio

T = datetime(2024, 5, 1)


@pytest.mark.parametrize("seed", range(8))
def test_growing_files_give_every_frame_once(seed):
    rng = random.Random(seed)
    data = radio(rng, 40)
    whole = [f for f in ranges.file_at_once(binary.Radio(), data)]
    found, start = [], 0
    while start < len(data):
        stop = min(len(data), start + rng.choice([1, 9, 50, 700, 5_000]))
        found += frames.frames_that_end(binary.Radio(), lambda a, b, stop=stop: data[a : min(b, stop)], start, stop)
        start = stop
    ends = {f[0] for f in found}
    # A last frame without its check bytes waits for them.
    assert found == [f for f in whole if f[0] in ends] and len(whole) - len(found) <= 1


def test_logs_are_read_as_they_grow(spark, tmp_path):
    data = [radio(random.Random(k), 50) for k in range(2)]
    (tmp_path / "in").mkdir()
    stream = frames.stream_radio_frames(spark, f"file://{tmp_path}/in", 1_000)
    query = stream.writeStream.format("memory").queryName("grown").start()
    try:
        for share in (0.3, 0.31, 1.0):
            for k, d in enumerate(data):
                if k == 0 or share > 0.3:
                    (tmp_path / "in" / f"{k}.tlog").write_bytes(d[: int(len(d) * share)])
            query.processAllAvailable()
        found = sorted((r.file[-6:], r.off, r.us) for r in spark.table("grown").collect())
    finally:
        query.stop()
    whole = sorted((f"{k}.tlog", f[0], f[1]) for k, d in enumerate(data) for f in ranges.file_at_once(binary.Radio(), d))
    assert len(whole) - len(found) <= 2 and set(found) <= set(whole) and len(set(found)) == len(found)


def test_state_goes_with_the_watermark(spark):
    rows = spark.createDataFrame([(c, i, T + timedelta(hours=i), 1.0, 1.0, i // 50) for c in (1, 2) for i in range(200)], "case_id long, seq long, ts timestamp, altitude_m double, ground_speed_mps double, batch int")
    stream = jobs.stream_windows(jobs.delivered(rows, F.col("batch"), 4), "1 hour", "1 hour", "5 hours")
    query = stream.writeStream.format("memory").queryName("evicted").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) for p in query.recentProgress) if p["stateOperators"]]
    # Both cases keep the windows of five hours at most, however many there were.
    assert max(held) <= 2 * 56 and held[-1] <= 2 * 6
    assert spark.table("evicted").count() == 400 - held[-1]


def test_an_export_is_one_json_document_of_any_size(spark, tmp_path):
    cases = spark.createDataFrame([(1, 'a "b"'), (2, None)], "case_id long, title string")
    many = spark.range(3_000).select(F.lit(1).cast("long").alias("case_id"), (F.col("id") % 7 == 0).alias("odd"), F.col("id").alias("n"), F.lit('x "y"\n').alias("text"))
    none = many.limit(0)
    items = spark.createDataFrame([(1, 3, "LOGS"), (1, 1, "GCS"), (1, 2, "LOGS"), (9, 1, "LOGS")], "case_id long, n long, category string")
    counts = items.groupBy("case_id").agg(F.count("*").alias("total"))
    arrays = {n: (none, ["n"]) for n in ("geofence_violations", "timeline", "chain_of_custody", "wireless_sessions", "media_items")} | {"anomalies": (many, ["n"])}
    export.write_case_json(cases, {"flight_summary": counts}, arrays, (items, ["n"]), counts, "now", f"file://{tmp_path}/out")
    found = {}
    for folder in (tmp_path / "out").glob("case_id=*"):
        files = list(folder.glob("part-*"))
        assert len(files) == 1
        found[int(folder.name[8:])] = json.loads(files[0].read_text())
    assert set(found) == {1, 2} and len(found[1]) == 15
    assert [a["n"] for a in found[1]["anomalies"]] == list(range(3_000)) and found[1]["anomalies"][5]["text"] == 'x "y"\n'
    assert found[1]["case"] == {"title": 'a "b"', "case_id": 1} or found[1]["case"]["title"] == 'a "b"'
    assert [i["n"] for i in found[1]["evidence_items"]] == [1, 2, 3] and found[1]["evidence_by_category"] == {"logs": [{"n": 2, "category": "LOGS"}, {"n": 3, "category": "LOGS"}], "video_images": [], "gcs": [{"n": 1, "category": "GCS"}]}
    assert found[2]["anomalies"] == [] and found[2]["flight_summary"] is None and found[2]["generated_at_utc"] == "now"


def test_window_texts_have_all_their_fields(spark):
    rows = spark.createDataFrame([(1, 0, i, T + timedelta(seconds=i), 10.0 + i, 20.0, 5.0 + i, 3.0, 90.0 - i, "GPS") for i in range(4)], "case_id long, ingest_seq long, seq long, ts timestamp, latitude double, longitude double, altitude_m double, ground_speed_mps double, battery_pct double, source_channel string")
    found = retrieval.chunk_windows(summary.telemetry_windows(rows, ends=True)).first()
    assert found.text == (
        "[TELEMETRY_WINDOW] Time: 2024-05-01T00:00:00Z to 2024-05-01T00:00:03Z (4 samples) | Start Location: lat=10.000000, lon=20.000000, alt=5.0m | End Location: lat=13.000000, lon=20.000000, alt=8.0m"
        " | Altitude Range: 5.0m to 8.0m | Max Speed: 3.0 m/s (avg 3.0 m/s) | Batt: 87.0% - 90.0% | Source: GPS"
    )
    assert found.metadata["start_time_utc"] == "2024-05-01T00:00:00Z" and found.metadata["max_altitude_m"] == "8.0"


def test_stored_tables_are_deleted_and_others_are_not(spark, tmp_path):
    kept = stored(spark.range(5))
    folder = kept.inputFiles()[0]
    assert kept.count() == 5 and "/tables/" in folder
    forget(kept)
    spark.range(2).write.parquet(f"file://{tmp_path}/own")
    with pytest.raises(ValueError, match="not a stored table"):
        forget(spark.read.parquet(f"file://{tmp_path}/own"))
    assert shared_dir(spark) and binary_logs.RANGE


def test_a_report_of_many_files_is_one_document(spark, tmp_path, monkeypatch):
    """No task takes a case: its lines fill several files, and rows are read from each without the others."""
    monkeypatch.setattr(export, "LINES_A_FILE", 500)
    total = spark.createDataFrame([(1, 5), (2, None)], "case_id long, points long")
    many = spark.range(4_000).select(F.lit(1).cast("long").alias("case_id"), F.col("id").alias("n"), F.lit('"x": [\n').alias("text"), F.col("id").alias("_o"))
    few = spark.createDataFrame([(1, 3), (2, 8), (2, 7)], "case_id long, n long")
    export.write_report(total, {"violations": (many, ["_o"]), "episodes": (few, ["n"])}, f"file://{tmp_path}/out")
    parts = sorted((tmp_path / "out" / "case_id=1").glob("part-*"))
    assert len(parts) > 4 and max(len(p.read_text().splitlines()) for p in parts) < 2_000
    found = json.loads("".join(p.read_text() for p in parts))
    assert found["case_id"] == 1 and found["summary"] == {"points": 5} and [v["n"] for v in found["violations"]] == list(range(4_000)) and found["episodes"] == [{"n": 3}]
    read = export.read_rows(spark, f"file://{tmp_path}/out").orderBy("case_id", "number", "block", "id").collect()
    assert [(r.case_id, r.array, json.loads(r.value)["n"]) for r in read] == [*((1, "violations", n) for n in range(4_000)), (1, "episodes", 3), (2, "episodes", 7), (2, "episodes", 8)]


def test_an_export_takes_little_disk_beside_its_rows(spark, tmp_path, monkeypatch):
    """Documents can be gzip files that follow each other, lines are kept with what is asked for alone, and shuffle files go with their query."""
    monkeypatch.setattr(export, "LINES_A_FILE", 500)
    kept, places = [], []
    monkeypatch.setattr(export, "stored", lambda df, *a: kept.append(stored(df, *a)) or places.extend(kept[-1].inputFiles()) or kept[-1])
    total = spark.createDataFrame([(1, 5), (2, None)], "case_id long, points long")
    many = spark.range(4_000).select(F.lit(1).cast("long").alias("case_id"), F.col("id").alias("n"), F.lit("long text " * 50).alias("text"), F.col("id").alias("_o"))
    few = spark.createDataFrame([(1, 3), (2, 8), (2, 7)], "case_id long, m long")
    export.write_report(total, {"violations": (many, ["_o"]), "episodes": (few, ["m"])}, f"file://{tmp_path}/out", "gzip")
    parts = sorted((tmp_path / "out" / "case_id=1").glob("part-*"))
    assert len(parts) > 4 and sum(p.stat().st_size for p in parts) < 4_000 * 50
    found = json.loads(gzip.decompress(b"".join(p.read_bytes() for p in parts)))
    assert [v["n"] for v in found["violations"]] == list(range(4_000)) and found["violations"][7]["text"] == "long text " * 50 and found["episodes"] == [{"m": 3}]
    assert not any(os.path.exists(urlsplit(p).path) for p in places)  # what was stored for the documents
    kept.clear()
    read = export.read_rows(spark, f"file://{tmp_path}/out", lambda row: F.get_json_object(row, "$.n")).orderBy("case_id", "number", "block", "id").collect()
    assert [(r.case_id, r.array, r.value) for r in read] == [*((1, "violations", str(n)) for n in range(4_000)), (1, "episodes", None), (2, "episodes", None), (2, "episodes", None)]
    lines = kept[0].filter("head = ''")
    assert lines.count() == 4_003 and lines.agg(F.max(F.length("value"))).first()[0] == 4


def test_shuffle_files_go_with_what_is_stored(spark):
    local = os.path.join(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {f for _, _, names in os.walk(local) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before = files()
    kept = stored(spark.range(10_000).repartition(7))
    assert not files() - before and kept.count() == 10_000


def test_keys_are_hashed_in_order_across_batches_and_files(spark):
    rows = [(c, p, n % 3, 0, n, f"{p}{n}") for c in (1, 2) for p in ("a", "b") for n in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = exports._digests(spark.createDataFrame(rows, "case_id long, part string, number int, block long, id long, k string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(c, p): hashlib.sha256(",".join(f"{p}{n}" for n in sorted(range(300), key=lambda n: (n % 3, n))).encode()).hexdigest() for c in (1, 2) for p in ("a", "b")}
    assert {(r.case_id, r.part): r.keys_sha256 for r in found} == want and {r.n for r in found} == {300}
