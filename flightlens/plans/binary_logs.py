"""Queries of the binary readers: telemetry written as logs, captures, images and movies, and read again.

Files are small beside the readers' usual ranges, so the queries read them in ranges of RANGE
bytes: what is checked is the reading across ranges.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.operators.places import numbered
from flightlens.plans import files, views
from flightlens.plans.catalog import query
from flightlens.session import shared_dir, stored
from flightlens.sources import binary, binary_files, ranges

RANGE = 50_000
#: Rows that one piece of a file holds at most: a file is put together by one task.
PIECE = 64
_TEL = files._TEL + ", e AS (SELECT *, CAST(round(latitude * 1e7) AS BIGINT) AS lat7, CAST(round(longitude * 1e7) AS BIGINT) AS lon7, CAST(round(altitude_m * 100) AS BIGINT) AS alt2, CAST(epoch(ts) AS BIGINT) AS sec FROM f)"


def pieces(spark: SparkSession, sf_dir: str, name: str, encode: Callable[[tuple, int], bytes], head: bytes = b"") -> DataFrame:
    """(file, ord, data) of files made of telemetry: head, then encode(row, place) for each row of a case in seq order."""
    rows = files._rows(spark, sf_dir).select(
        F.col("case_id").cast("long").alias("case_id"), F.lit(0).alias("ingest_seq"), "seq", F.round(F.col("lat").cast("double") * 1e7).cast("long").alias("lat7"), F.round(F.col("lon").cast("double") * 1e7).cast("long").alias("lon7"),
        F.round(F.col("alt").cast("double") * 100).cast("long").alias("alt2"), F.round("ground_speed_mps", 1).alias("speed"), F.unix_seconds("ts").alias("sec"),
    )
    placed = numbered(rows, "place", ["case_id"], {"_stretch": F.floor(F.col("seq") / 100_000)}, ["seq"])
    dealt = placed.repartition("case_id", F.floor(F.col("place") / (PIECE * 100))).sortWithinPartitions("case_id", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[int, int], tuple[int, list[bytes]]] = {}
            for row in batch.itertuples(index=False):
                _, data = found.setdefault((row.case_id, row.place // PIECE), (row.place, []))
                data.append((head if row.place == 1 else b"") + encode(row, row.place - 1))
            yield pd.DataFrame([(f"case_id={c}/{name}", first, b"".join(data)) for (c, _), (first, data) in found.items()], columns=["file", "ord", "data"])

    return dealt.mapInPandas(run, "file string, ord long, data binary")


def encoded(spark: SparkSession, sf_dir: str, name: str, encode: Callable[[tuple, int], bytes], head: bytes = b"") -> str:
    """The folder of those files."""
    return binary_files.write_files(pieces(spark, sf_dir, name, encode, head), f"{shared_dir(spark)}/files/{uuid.uuid4().hex}")


def _in_order(rows: DataFrame, off: str = "seq") -> DataFrame:
    """Rows of files with the case and, as n, their number in it."""
    return numbered(files.of_case(rows), "n", ["file"], ranges.by_offset(off), [off])


# ---------------------------------------------------------------- flash logs

_FORMATS = {
    "GPS": (130, "QBIHBLLef", "TimeUS,Status,GMS,GWk,NSats,Lat,Lng,Alt,Spd"),
    "ATT": (131, "Qccc", "TimeUS,Roll,Pitch,Yaw"),
    "EV": (132, "QB", "TimeUS,Id"),
    "PARM": (133, "QNf", "TimeUS,Name,Value"),
    "MSG": (134, "QZ", "TimeUS,Message"),
}
_PACKED = {n: struct.Struct("<" + "".join(binary.FORMATS[c][0] for c in form)) for n, (_, form, _) in _FORMATS.items()}


def _message(name: str, *values) -> bytes:
    return binary.MARKER + bytes([_FORMATS[name][0]]) + _PACKED[name].pack(*values)


def _flash_rows(row, place: int) -> bytes:
    week, second = divmod(row.sec - binary.GPS_EPOCH_S, binary.WEEK_S)
    out = _message("ATT", place, row.seq % 90 * 100, -(row.seq % 45) * 100, row.seq % 360 * 100 - 18_000) if row.seq % 3 == 0 else b""
    out += _message("GPS", place, 3, second * 1000, week, row.seq % 12, row.lat7, row.lon7, row.alt2, row.speed)
    if row.seq % 5 == 0:
        out += _message("EV", place, (10, 25, 11)[row.seq // 5 % 3])
    if row.seq % 7 == 0:
        out += _message("PARM", place, f"P{row.seq % 84}".encode(), float(row.seq))
    if row.seq % 9 == 0:
        out += _message("MSG", place, (f"ArduCopter V{row.seq}", f"Frame: QUAD {row.seq}", f"CubeOrange {row.seq}")[row.seq // 9 % 3].encode())
    return out + (b"", b"\xa3\x95noise", b"\xa3", b"\x95\xa3\x95\x07")[place % 4]  # markers that belong to nothing


_DECLARED = b"".join(
    binary.MARKER + bytes([binary.DECLARATION]) + struct.pack("<BB4s16s64s", number, _PACKED[name].size + 3, name.encode(), form.encode(), labels.encode()) for name, (number, form, labels) in _FORMATS.items()
)


def flash_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.dataflash_messages(spark, encoded(spark, sf_dir, "flight.bin", _flash_rows, _DECLARED), RANGE)


@query(
    "read_dataflash",
    _TEL + """, a AS (SELECT *, last_value(CASE WHEN id % 3 = 0 THEN id END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY id) AS att FROM e)
SELECT case_id, seq + 1 AS n, ts, latitude, longitude, altitude_m, round(ground_speed_mps, 1) AS ground_speed_mps, sats AS satellites_visible, CAST(att % 90 AS DOUBLE) AS roll_deg, CAST(-(att % 45) AS DOUBLE) AS pitch_deg,
       CASE WHEN att % 360 <> 180 THEN CAST(att % 360 - 180 AS DOUBLE) ELSE 0.0 END AS yaw_deg FROM a""",
)
def read_dataflash(spark, sf_dir):
    found = _in_order(binary.dataflash_telemetry(flash_messages(spark, sf_dir)))
    near = lambda c, digits: (F.round(c, digits) + 0.0).alias(c)
    return found.select("case_id", "n", "ts", near("latitude", 7), near("longitude", 7), near("altitude_m", 2), near("ground_speed_mps", 1), "satellites_visible", *[near(c, 2) for c in ("roll_deg", "pitch_deg", "yaw_deg")])


@query(
    "read_dataflash_events",
    _TEL + " SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY id) AS n, CASE id // 5 % 3 WHEN 0 THEN 'ARM' WHEN 1 THEN 'FAILSAFE' ELSE 'DISARM' END AS event_type, latitude, longitude FROM e WHERE id % 5 = 0",
)
def read_dataflash_events(spark, sf_dir):
    return _in_order(binary.dataflash_events(flash_messages(spark, sf_dir))).select("case_id", "n", "event_type", F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"))


@query(
    "dataflash_summary",
    _TEL + """, m AS (SELECT case_id, max(CASE WHEN id // 9 % 3 = 0 THEN id END) AS a, max(CASE WHEN id // 9 % 3 = 1 THEN id END) AS b, max(CASE WHEN id // 9 % 3 = 2 THEN id END) AS c FROM e WHERE id % 9 = 0 GROUP BY case_id),
p AS (SELECT case_id, 'P' || (id % 84) AS name, min(id) AS first, max(id) AS last FROM e WHERE id % 7 = 0 GROUP BY ALL),
q AS (SELECT case_id, count(*) AS params_total, CAST(sum(last) AS DOUBLE) AS value_sum, arg_min(name, first) AS first_name FROM p GROUP BY case_id)
SELECT case_id, params_total, value_sum, first_name, coalesce('ArduCopter V' || a, 'ArduPilot') AS firmware, coalesce('QUAD ' || b, 'Standard') AS frame, coalesce('CubeOrange ' || c, 'Pixhawk / STM32 Autopilot') AS board FROM q LEFT JOIN m USING (case_id)""",
)
def dataflash_summary(spark, sf_dir):
    messages = stored(flash_messages(spark, sf_dir).filter(F.col("msg").isin("PARM", "MSG")))
    first = binary.dataflash_summary(messages, 1).select("file", F.map_keys("params")[0].alias("first_name"))
    found = files.of_case(binary.dataflash_summary(messages, 100).join(first, "file"))
    return found.select("case_id", "params_total", F.aggregate(F.map_values("params"), F.lit(0.0), lambda s, x: s + x).alias("value_sum"), "first_name", "firmware", "frame", "board")


# ---------------------------------------------------------------- radio logs


def _frame(us: int, msg: int, payload: bytes, second: bool) -> bytes:
    if second:
        return us.to_bytes(8, "big") + bytes([0xFD, len(payload), 0, 0, 0, 1, 1]) + msg.to_bytes(3, "little") + payload + b"\0\0"
    return us.to_bytes(8, "big") + bytes([0xFE, len(payload), 0, 1, 1, msg]) + payload + b"\0\0"


def _radio_rows(row, place: int) -> bytes:
    us, second = row.sec * 1_000_000, row.seq % 2 == 0
    out = _frame(us, binary.POSITION, struct.pack("<IiiiihhhH", place, row.lat7, row.lon7, 0, row.alt2 * 10, 300, 400, 0, 0), second)
    if row.seq % 3 == 0:  # every other raw row stands at the time of the position before it
        out += _frame(us + row.seq % 2, binary.RAW_GPS, struct.pack("<QiiiHHHHBB", us, row.lat7, row.lon7, row.alt2 * 10, 0, 0, row.seq % 200 * 10, 0, 3, row.seq % 12), second)
    if row.seq % 4 == 0:
        out += _frame(us, binary.HEARTBEAT, struct.pack("<IBBBBB", 0, 2, 3, 128 * (row.seq // 4 % 2), 4, 3), second)
    if row.seq % 10 == 0:
        out += _frame(us, binary.TEXT, bytes([row.seq // 10 % 7]) + (f"Failsafe {row.seq}" if row.seq % 20 == 0 else f"note {row.seq}").encode().ljust(50, b"\0"), second)
    if place == 0:
        out += _frame(us, binary.HOME, struct.pack("<iii", row.lat7, row.lon7, 5000), second)
    return out + (b"damaged bytes" if row.seq % 11 == 0 else b"")


def _numbered_radio_rows(row, place: int) -> bytes:
    """Radio rows whose positions carry the row's id as boot time."""
    return _radio_rows(row, row.seq)


def radio_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.radio_messages(spark, encoded(spark, sf_dir, "flight.tlog", _radio_rows), RANGE)


@query(
    "read_tlog",
    _TEL + """, r AS (
  SELECT case_id, id, 0 AS k, ts, latitude, longitude, altitude_m, 5.0 AS ground_speed_mps, CAST(NULL AS INTEGER) AS satellites_visible, 'GLOBAL_POSITION_INT' AS source_channel FROM e
  UNION ALL SELECT case_id, id, 1, ts + to_microseconds(id % 2), latitude, longitude, altitude_m, CAST(id % 200 / 10.0 AS DOUBLE), CAST(id % 12 AS INTEGER), 'GPS_RAW_INT' FROM e WHERE id % 3 = 0 AND id % 2 = 1)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY id, k) AS n, ts, latitude, longitude, altitude_m, ground_speed_mps, satellites_visible, source_channel FROM r""",
)
def read_tlog(spark, sf_dir):
    return _in_order(binary.radio_telemetry(radio_log(spark, sf_dir))).select("case_id", "n", "ts", "latitude", "longitude", "altitude_m", "ground_speed_mps", "satellites_visible", "source_channel")


@query(
    "read_tlog_events",
    _TEL + """, h AS (SELECT case_id, id, ts, id // 4 % 2 AS armed, coalesce(lag(id // 4 % 2) OVER (PARTITION BY case_id ORDER BY id), 0) AS before FROM e WHERE id % 4 = 0),
v AS (SELECT case_id, id, 0 AS k, ts, CASE WHEN armed = 1 THEN 'ARM' ELSE 'DISARM' END AS event_type, 'INFO' AS severity, CAST(NULL AS VARCHAR) AS description FROM h WHERE armed <> before
  UNION ALL SELECT case_id, id, 1, ts, CASE WHEN id % 20 = 0 THEN 'FAILSAFE' ELSE 'ERROR_ALERT' END, CASE WHEN id // 10 % 7 <= 2 THEN 'CRITICAL' WHEN id // 10 % 7 <= 4 THEN 'WARNING' ELSE 'INFO' END,
    CASE WHEN id % 20 = 0 THEN 'Failsafe ' || id ELSE 'note ' || id END FROM e WHERE id % 10 = 0)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY id, k) AS n, ts, event_type, severity, description FROM v""",
)
def read_tlog_events(spark, sf_dir):
    return _in_order(binary.radio_events(radio_log(spark, sf_dir))).select("case_id", "n", "ts", "event_type", "severity", "description")


@query("read_tlog_homes", _TEL + " SELECT case_id, latitude, longitude, CAST(5 AS DOUBLE) AS altitude_m FROM e WHERE seq = 0")
def read_tlog_homes(spark, sf_dir):
    return files.of_case(binary.radio_homes(radio_log(spark, sf_dir))).select("case_id", "latitude", "longitude", "altitude_m")


@query("radio_message_counts", _TEL + " SELECT case_id, 33 AS msg_id, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT case_id, 24, count(*) FROM e WHERE id % 3 = 0 GROUP BY 1 UNION ALL SELECT case_id, 0, count(*) FROM e WHERE id % 4 = 0 GROUP BY 1 UNION ALL SELECT case_id, 253, count(*) FROM e WHERE id % 10 = 0 GROUP BY 1 UNION ALL SELECT case_id, 242, 1 FROM e WHERE seq = 0")
def radio_message_counts(spark, sf_dir):
    return files.of_case(radio_log(spark, sf_dir)).groupBy("case_id", "msg_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- captures


def _packet_rows(order: str) -> Callable[[tuple, int], bytes]:
    def rows(row, place: int) -> bytes:
        payload = b"\1\2\3\4\5\6" + bytes([2, 0, 0, 0, row.case_id, row.seq % 40]) + b"\x08\0" + f"packet {row.seq} ".encode()
        payload += b"\xfe\x09" * (row.seq % 3 == 0) + f"DJI-Mavic-{row.case_id}\0".encode() * (row.seq % 11 == 0) + b"x" * (row.seq % 64)
        return struct.pack(order + "IIII", row.sec, 0, len(payload), len(payload)) + payload

    return rows


def capture(spark: SparkSession, sf_dir: str, order: str) -> str:
    mark = binary.CAPTURE_MARKS[0 if order == ">" else 1]
    return encoded(spark, sf_dir, "air.pcap", _packet_rows(order), mark + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65_535, 1))


_PACKETS = _TEL + " SELECT case_id, seq AS n, sec AS ts_sec, length('packet ' || id || ' ') + 14 + CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN id % 11 = 0 THEN length('DJI-Mavic-' || case_id) + 1 ELSE 0 END + id % 64 AS size FROM e"


@query("read_pcap", _PACKETS)
def read_pcap(spark, sf_dir):
    return files.of_case(binary.read_pcap(spark, capture(spark, sf_dir, "<"), None, RANGE)).select("case_id", "n", "ts_sec", "size")


@query("read_pcap_big_endian", _PACKETS)
def read_pcap_big_endian(spark, sf_dir):
    return files.of_case(binary.read_pcap(spark, capture(spark, sf_dir, ">"), None, RANGE)).select("case_id", "n", "ts_sec", "size")


@query(
    "pcap_summary",
    _TEL + """, p AS (SELECT *, printf('02:00:00:00:%02x:%02x', case_id, id % 40) AS mac FROM e), m AS (SELECT case_id, mac, min(seq) AS first FROM p GROUP BY case_id, mac QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY min(seq)) <= 15)
SELECT case_id, count(*) AS packets, CAST(count_if(id % 3 = 0) AS BIGINT) AS telemetry_frames, CASE WHEN count_if(id % 11 = 0) > 0 THEN 'DJI-Mavic-' || case_id || ',Mavic-' || case_id ELSE '' END AS ssids,
       (SELECT string_agg(mac, ',' ORDER BY mac) FROM m WHERE m.case_id = p.case_id) AS macs FROM p GROUP BY case_id""",
)
def pcap_summary(spark, sf_dir):
    found = files.of_case(binary.pcap_summary(binary.read_pcap(spark, capture(spark, sf_dir, "<"), None, RANGE)))
    return found.select("case_id", "packets", "telemetry_frames", F.array_join("ssids", ",").alias("ssids"), F.array_join("macs", ",").alias("macs"))


# ---------------------------------------------------------------- images and movies

BLOCK = 256


def _image_rows(row, place: int) -> bytes:
    out = b""
    if row.seq % 4 == 0:
        out = b"\xff\xd8\xff" + f"picture {row.seq:012d}".encode() + b"\xff\xd9"
    elif row.seq % 4 == 1:
        out = b"\x89PNG\r\n\x1a\n" + b"I" * (row.seq % 100) + b"IEND\xaeB`\x82"
    elif row.seq % 12 == 2:
        out = b"ULog\x01\x12\x35"
    return out.ljust(BLOCK, b"\0")


_EXTENTS = _TEL + f""", s AS (SELECT case_id, count(*) * {BLOCK} AS total FROM e GROUP BY case_id),
x AS (SELECT case_id, 0 AS rank, 'JPEG_PHOTO' AS file_type, seq * {BLOCK} AS byte_offset, 25 AS size_bytes, id FROM e WHERE id % 4 = 0
  UNION ALL SELECT case_id, 1, 'PNG_IMAGE', seq * {BLOCK}, 16 + id % 100, id FROM e WHERE id % 4 = 1
  UNION ALL SELECT case_id, 3, 'PX4_ULOG', seq * {BLOCK}, least(total - seq * {BLOCK}, 10485760), id FROM e JOIN s USING (case_id) WHERE id % 12 = 2),
c AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, byte_offset) AS carve_id FROM x)"""


@query("carve_extents", _EXTENTS + " SELECT case_id, carve_id, file_type, byte_offset, CAST(size_bytes AS BIGINT) AS size_bytes FROM c")
def carve_extents(spark, sf_dir):
    found = binary.carve_extents(spark, encoded(spark, sf_dir, "disk.raw", _image_rows), None, RANGE)
    return files.of_case(found).select("case_id", F.col("carve_id").cast("long").alias("carve_id"), "file_type", "byte_offset", "size_bytes")


@query("carved_hashes", _EXTENTS + " SELECT case_id, carve_id, byte_offset, sha256('\\xFF\\xD8\\xFF'::BLOB || encode(printf('picture %012d', id)) || '\\xFF\\xD9'::BLOB) AS sha256 FROM c WHERE rank = 0")
def carved_hashes(spark, sf_dir):
    extents = binary.carve_extents(spark, encoded(spark, sf_dir, "disk.raw", _image_rows), None, RANGE).filter("file_type = 'JPEG_PHOTO'")
    return files.of_case(binary.hash_extents(spark, extents)).select("case_id", F.col("carve_id").cast("long").alias("carve_id"), "byte_offset", "sha256")


def _box(name: bytes, content: bytes) -> bytes:
    return struct.pack(">I", len(content) + 8) + name + content


def _movie_rows(row, place: int) -> bytes:
    """A case's rows are media data, each a box; the first row also holds the movie header, in odd cases behind its data."""
    created, data = row.sec + binary.MEDIA_EPOCH_S, _box(b"mdat", b"not mvhd but data " * (row.seq % 5))
    if place:
        return data
    head = b"\1\0\0\0" + struct.pack(">QQIQ", created, created, 600, row.alt2) if row.case_id % 4 < 2 else b"\0\0\0\0" + struct.pack(">IIII", created, created, 600, row.alt2)
    movie = _box(b"moov", _box(b"udta", b"name") + _box(b"mvhd", head + b"\0" * 80))
    return _box(b"ftyp", b"isom") + (data + movie if row.case_id % 2 else movie + data)


@query("container_times", _TEL + " SELECT case_id, ts AS created, alt2 / CAST(600 AS DOUBLE) AS duration_sec FROM e WHERE seq = 0")
def container_times(spark, sf_dir):
    return files.of_case(binary.read_container_times(spark, encoded(spark, sf_dir, "clip.mp4", _movie_rows))).select("case_id", "created", "duration_sec")
