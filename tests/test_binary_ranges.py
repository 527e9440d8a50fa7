"""Files of frames read in ranges of any size give what they give in one."""

from __future__ import annotations

import hashlib
import random
import struct
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flightlens.plans import binary_logs
from flightlens.plans.catalog import ORACLE_SQL
from flightlens.sources import binary, binary_files, ranges


class Row:
    def __init__(self, seq):
        self.case_id, self.seq, self.sec = 3, seq, 1_704_067_200 + seq
        self.lat7, self.lon7, self.alt2, self.speed = 188_500_000 + seq, 726_500_000 - seq, 100 * seq, seq / 10


def flash(rng, n=60):
    parts = [binary_logs._DECLARED]
    for place in range(n):
        parts.append(binary_logs._flash_rows(Row(rng.randrange(10_000)), place))
        if rng.random() < 0.2:
            parts.append(rng.choice([bytes(rng.randrange(256) for _ in range(rng.randrange(40))), b"\xa3\x95", b"\xa3\x95\x82", b"\xa3" * 5, binary_logs._DECLARED[:89]]))
    if rng.random() < 0.5:  # a format declared anew, with other labels
        parts.insert(n // 2, b"\xa3\x95\x80" + struct.pack("<BB4s16s64s", 132, 12, b"EV2", b"QB", b"TimeUS,Code"))
    return b"".join(parts)


def radio(rng, n=60):
    parts = []
    for place in range(n):
        parts.append(binary_logs._radio_rows(Row(rng.randrange(10_000)), place))
        if rng.random() < 0.2:
            parts.append(rng.choice([b"\xfe" * 20, bytes(rng.randrange(256) for _ in range(rng.randrange(300))), parts[-1][:30], b"\0" * 200]))
    return b"".join(parts)


def packets(rng, n=80, order="<"):
    head = binary.CAPTURE_MARKS[1] + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65_535, 1)
    parts = [head] + [binary_logs._packet_rows(order)(Row(rng.randrange(10_000)), i) for i in range(n)]
    if rng.random() < 0.5:
        parts.append(struct.pack(order + "IIII", 1, 0, 500, 500) + b"cut")
    return b"".join(parts)


def in_ranges(make, data, size):
    found = []
    for start in range(0, len(data), size):
        found += ranges.frames_of(make(data), lambda a, b: data[a:b], start, min(len(data), start + size), len(data))
    return found


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("size", [1, 7, 64, 100, 1_000, 4_096])
def test_any_range_size_gives_the_frames_of_the_whole_file(seed, size):
    rng = random.Random(seed)
    data = flash(rng, 12 if size < 50 else 60)
    declared = [f for f in in_ranges(lambda d: binary.Declarations(), data, size)]
    assert declared == ranges.file_at_once(binary.Declarations(), data) and len(declared) >= 5
    whole = ranges.file_at_once(binary.Dataflash(b"", declared), data)
    assert in_ranges(lambda d: binary.Dataflash(b"", declared), data, size) == whole and len(whole) > 10
    data = radio(rng, 12 if size < 50 else 60)
    whole = ranges.file_at_once(binary.Radio(), data)
    assert in_ranges(lambda d: binary.Radio(), data, size) == whole and len(whole) > 10


@pytest.mark.parametrize("size", [37, 400, 5_000])
@pytest.mark.parametrize("seed", range(4))
def test_packets_are_found_in_any_range(seed, size):
    data = packets(random.Random(seed))
    make = lambda d: binary.Capture(d[:40])
    whole = ranges.file_at_once(make(data), data)
    assert in_ranges(make, data, size) == whole and len(whole) == 80


@pytest.mark.parametrize("seed", range(20))
def test_headers_are_found_in_any_range_as_in_one_pass(seed):
    rng = random.Random(seed)
    header = rng.choice([b"\xa3\x95", b"\xff\xd8\xff", b"aa"])
    data = b"".join(rng.choice([header, header[:1], header[1:], b"\0" * rng.randrange(4), b"x" * rng.randrange(900)]) for _ in range(300))
    want, at = [], data.find(header)
    while at >= 0:
        want.append(at)
        at = data.find(header, at + len(header) + 1)
    for size in (1, 5, 64, 1_000, len(data)):
        if size == 1 and len(data) > 20_000:
            continue
        found = []
        for start in range(0, len(data), size):
            found += binary.header_places(lambda a, b: data[a:b], header, start, min(len(data), start + size), len(data))
        assert found == want, size


def test_a_chain_without_any_gap_is_followed_from_the_start():
    data = b"a" * 5_000
    found = [p for s in range(0, 5_000, 333) for p in binary.header_places(lambda a, b: data[a:b], b"aa", s, min(5_000, s + 333), 5_000)]
    assert found == list(range(0, 4_999, 3))


def test_movie_headers_are_reached_by_the_box_tree():
    box = binary_logs._box
    head = b"\0\0\0\0" + struct.pack(">IIII", 1, 2, 3, 4) + b"\0" * 80
    large = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + 2_000_000) + b"mvhd" * 500_000
    for data in (large + box(b"moov", box(b"mvhd", head)), box(b"ftyp", b"x") + box(b"moov", box(b"free", b"mvhd no") + box(b"mvhd", head)) + large, b"\0" * 300 + b"mvhd" + head):
        reads = []

        def read(a, b, data=data, reads=reads):
            reads.append(b - a)
            return data[a:b]

        assert binary.movie_header(read, len(data))[:20] == head[:20]
    assert binary.movie_header(lambda a, b: b"\0" * (b - a), 100) is None


def test_files_are_written_whole_and_in_order(spark, tmp_path):
    rows = [(f"d{i % 3}/f", i, bytes([i % 256]) * 3) for i in range(300)]
    folder = f"file://{tmp_path}/out"
    binary_files.write_files(spark.createDataFrame(rows, "file string, ord long, data binary").repartition(5), folder)
    for k in range(3):
        assert (tmp_path / "out" / f"d{k}" / "f").read_bytes() == b"".join(bytes([i % 256]) * 3 for i in range(300) if i % 3 == k)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d0", "d1", "d2"]


@pytest.mark.parametrize("size", [1_000, 10**9])
def test_readers_give_the_same_at_any_range_size(spark, tmp_path, size):
    rng = random.Random(1)
    for k in range(2):
        (tmp_path / f"{k}.bin").write_bytes(flash(rng))
        (tmp_path / f"{k}.tlog").write_bytes(radio(rng))
        (tmp_path / f"{k}.pcap").write_bytes(packets(rng))
    (tmp_path / "empty.bin").write_bytes(b"")
    for pattern, reader in (("*.bin", binary.dataflash_messages), ("*.tlog", binary.radio_messages), ("*.pcap", lambda s, p, z: binary.read_pcap(s, p, None, z)), ("*.pcap", lambda s, p, z: binary.carve_extents(s, p, None, z)), ("*.bin", lambda s, p, z: binary.carve_extents(s, p, 20, z))):
        path = f"file://{tmp_path}/{pattern}"
        key = lambda rows: sorted(map(str, rows))
        assert key(reader(spark, path, size).collect()) == key(reader(spark, path, 777).collect())


@pytest.mark.parametrize("order", ["<", ">"])
def test_a_capture_ends_where_a_packet_is_damaged_however_it_is_cut(spark, tmp_path, monkeypatch, order):
    """Packets behind the damage look whole, but no reader of the whole file comes to them."""
    monkeypatch.setattr(ranges, "TASK_BYTES", 300_000)
    head = binary.CAPTURE_MARKS[order == "<"] + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65_535, 1)
    many = [binary_logs._packet_rows(order)(Row(i), i) for i in range(40_000)]
    (tmp_path / "whole.pcap").write_bytes(head + b"".join(many))
    (tmp_path / "damaged.pcap").write_bytes(head + b"".join(many[:500]) + struct.pack(order + "IIII", 1, 0, 1 << 30, 1 << 30) + b"".join(many[500:]))
    found = binary.read_pcap(spark, f"file://{tmp_path}/*.pcap", None, 20_000).collect()
    for name, packets_read in (("whole", 40_000), ("damaged", 500)):
        rows = sorted((r.n, r.off, r.size) for r in found if r.file.endswith(f"{name}.pcap"))
        data = (tmp_path / f"{name}.pcap").read_bytes()
        assert rows == [(n, f[0], f[2]) for n, f in enumerate(ranges.file_at_once(binary.Capture(data[:40]), data))]
        assert len(rows) == packets_read


def test_frames_are_laid_out_as_columns_with_their_maps():
    kinds = pa.schema([("off", pa.int64()), ("numbers", pa.map_(pa.string(), pa.float64())), ("text", pa.string())])
    rows = [(1, {"a": 1.0, "b": None}, None), (2, {}, "x"), (3, {"a": 2.5}, "y")]
    found = ranges.batch_of(rows, kinds)
    assert [(r["off"], dict(r["numbers"]), r["text"]) for r in found.to_pylist()] == rows
    assert ranges.batch_of([], kinds).num_rows == 0


def test_a_file_comes_in_pieces_of_many_rows(spark, tmp_path):
    """The task that puts a file together gets a row for many rows of telemetry, and the same bytes."""
    pq.write_table(pa.table({
        "event_id": pa.array(range(20_000), pa.int64()), "ts": pa.array([datetime(2024, 5, 1, 10)] * 20_000, pa.timestamp("us")), "user_id": pa.array([i // 15_000 for i in range(20_000)], pa.int64()),
        "event_type": ["click"] * 20_000, "value": [1.5] * 20_000, "props": ['{"k": 1}'] * 20_000,
    }), tmp_path / "events.parquet")
    found = binary_logs.pieces(spark, str(tmp_path), "f", lambda row, place: f"{row.seq}:{place} ".encode(), b"head ").orderBy("file", "ord").collect()
    for case, (low, high) in enumerate(((0, 15_000), (15_000, 20_000))):
        assert b"".join(r["data"] for r in found if r["file"] == f"case_id={case}/f") == b"head " + b"".join(f"{i}:{i - low} ".encode() for i in range(low, high))
    assert len(found) < 20_000 / binary_logs.PIECE * 1.2


def table_of_one_case(folder, rows):
    pq.write_table(pa.table({
        "event_id": pa.array(range(rows), pa.int64()), "ts": pa.array([datetime(2024, 5, 1, 10)] * rows, pa.timestamp("us")), "user_id": pa.array([3] * rows, pa.int64()),
        "event_type": ["click"] * rows, "value": [1.5] * rows, "props": ['{"k": 1}'] * rows,
    }), folder / "events.parquet")


def test_every_packet_of_a_big_endian_capture_is_read(spark, tmp_path):
    table_of_one_case(tmp_path, 1_200)
    found = binary_logs.read_pcap_big_endian(spark, str(tmp_path)).orderBy("n").collect()
    assert [r.n for r in found] == list(range(1_200))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert sorted(con.execute(ORACLE_SQL["read_pcap_big_endian"]).fetchall()) == sorted(map(tuple, found))


def test_every_carved_picture_is_hashed(spark, tmp_path):
    """However many a disk image holds, and wherever they stand."""
    table_of_one_case(tmp_path, 1_200)
    found = binary_logs.carved_hashes(spark, str(tmp_path)).orderBy("carve_id").collect()
    assert [tuple(r) for r in found] == [(3, 1 + i, 4 * i * binary_logs.BLOCK, hashlib.sha256(b"\xff\xd8\xff" + f"picture {4 * i:012d}".encode() + b"\xff\xd9").hexdigest()) for i in range(300)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert sorted(con.execute(ORACLE_SQL["carved_hashes"]).fetchall()) == sorted(map(tuple, found))


def test_extents_of_any_size_and_order_are_hashed(spark, tmp_path):
    """Short ones from the bytes at hand, long ones piece by piece, and those that the file's end cuts."""
    rng = random.Random(3)
    data = {f: rng.randbytes(300_000) for f in "ab"}
    for f, d in data.items():
        (tmp_path / f).write_bytes(d)
    cut = [(f, rng.randrange(299_000), rng.choice([1, 25, 4_000, 65_536, 65_537, 200_000])) for f in "ab" for _ in range(200)]
    extents = spark.createDataFrame([(f"file://{tmp_path}/{f}", at, size) for f, at, size in cut], "file string, byte_offset long, size_bytes long").repartition(3)
    found = {(r.file[-1], r.byte_offset, r.size_bytes): (r.sha256, r.md5) for r in binary.hash_extents(spark, extents).collect()}
    assert found == {(f, at, size): (hashlib.sha256(data[f][at : at + size]).hexdigest(), hashlib.md5(data[f][at : at + size]).hexdigest()) for f, at, size in cut}


def test_marks_are_read_once(spark, tmp_path, monkeypatch):
    """Messages and marks that several aggregates use are read from their files once."""
    (tmp_path / "1.tlog").write_bytes(radio(random.Random(2)))
    kept = []
    monkeypatch.setattr(binary, "stored", lambda df: kept.append(df) or df)
    for reader in (binary.radio_events, binary.radio_telemetry):
        reader(binary.radio_messages(spark, f"file://{tmp_path}/*.tlog"))
    binary.carve_extents(spark, f"file://{tmp_path}/*.tlog")
    assert len(kept) == 3
