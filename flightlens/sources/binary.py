"""Binary files: only framing runs in Python, by byte ranges; meaning, order and filters are DataFrame work."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightlens.functions.geo import off_null_island
from flightlens.operators.asof import arm_edges, carry_forward
from flightlens.operators.places import numbered, previous, with_last
from flightlens.session import stored
from flightlens.sources import ranges

#: Message ids that a radio log is read for: position, raw GPS, home, heartbeat, text.
POSITION, RAW_GPS, HOME, HEARTBEAT, TEXT = 33, 24, 242, 0, 253
RESYNC_BYTES = 128
STAMP_RANGE = (1_200_000_000_000_000, 2_500_000_000_000_000)
ARMED_BIT = 128
GPS_EPOCH_S, WEEK_S = 315_964_800, 604_800


def read_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, length, content, modificationTime) of every file below path; a content that is asked for has to fit one row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def scan_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, byte_count) of every file below path; contents are not read."""
    return read_files(spark, path).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("byte_count"))


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of every file below path that has bytes; contents are not read."""
    return read_files(spark, path).select("path", "length")


HEAD_BYTES = 4096


def heads(spark: SparkSession, path: str | list[str], most: int = HEAD_BYTES) -> DataFrame:
    """(path, length, head) of every file below path; of each file the first `most` bytes are read."""
    files = listed(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for file, length in zip(batch["path"], batch["length"], strict=True):
                with ranges.open_file(file) as opened:
                    found.append(opened.read(min(most, length)))
            yield batch.assign(head=found)

    return files.mapInPandas(run, "path string, length long, head binary")


# ---------------------------------------------------------------- dataflash

#: Struct codes and scales of the log's format characters.
FORMATS = {
    "b": ("b", 1), "B": ("B", 1), "h": ("h", 1), "H": ("H", 1), "i": ("i", 1), "I": ("I", 1), "f": ("f", 1), "d": ("d", 1), "q": ("q", 1), "Q": ("Q", 1),
    "c": ("h", 0.01), "C": ("H", 0.01), "e": ("i", 0.01), "E": ("I", 0.01), "L": ("i", 1e-7), "M": ("B", 1), "n": ("4s", None), "N": ("16s", None), "Z": ("64s", None), "a": ("64s", None),
}


MARKER = b"\xa3\x95"
DECLARATION, DECLARATION_BYTES, MOST_MESSAGE_BYTES = 128, 89, 255
_DECLARED = struct.Struct("<BB4s16s64s")


class Declarations:
    """Framing of format declarations: each stands for itself, wherever a marker and its code stand."""

    first, longest = 0, DECLARATION_BYTES
    mark = MARKER + bytes([DECLARATION])

    def step(self, data: bytes, at: int, base: int) -> tuple[int | None, tuple | None]:
        found = data.find(self.mark, at)
        if found != at:
            return found if found > at else max(at + 1, len(data) - len(self.mark) + 1), None
        if at + DECLARATION_BYTES > len(data):
            return at + 1, None
        number, size, name, form, labels = (x if isinstance(x, int) else x.split(b"\0")[0].decode("latin-1") for x in _DECLARED.unpack_from(data, at + 3))
        known = all(c in FORMATS for c in form)
        return at + 1, (at, number, size, name, form, labels) if known else None

    def starts(self, data: bytes, upto: int) -> list[int]:
        return [upto - 1]


class Dataflash:
    """Framing of logs of marked messages whose formats are declared in the log.

    known: (off, number, size, name, form, labels) of the declarations; one holds from its place on.
    """

    first, longest = 0, MOST_MESSAGE_BYTES + 3

    def __init__(self, head: bytes, known: list | None) -> None:
        self.formats: dict[int, list[tuple]] = {}
        for off, number, size, name, form, labels in sorted(known if known is not None else ()):
            codes = [FORMATS[c] for c in form]
            packed = struct.Struct("<" + "".join(c[0] for c in codes))
            fits = packed.size <= size - 3
            self.formats.setdefault(number, []).append((off, name, size if fits else 0, packed, labels.split(","), [c[1] for c in codes]))

    def step(self, data: bytes, at: int, base: int) -> tuple[int | None, tuple | None]:
        found = data.find(MARKER, at)
        if found != at:  # a marker may begin with the last byte at hand
            return found if found > at else max(at + 1, len(data) - 1), None
        if at + 3 > len(data):
            return at + 1, None
        kind = data[at + 2]
        if kind == DECLARATION and at + DECLARATION_BYTES <= len(data):
            return at + DECLARATION_BYTES, None
        held = next((f for f in reversed(self.formats.get(kind, ())) if f[0] < base + at), None)
        if held is None or not held[2] or at + held[2] > len(data):
            return at + 1, None
        _, name, size, packed, labels, scales = held
        numbers, texts = {}, {}
        for label, scale, value in zip(labels, scales, packed.unpack_from(data, at + 3), strict=False):
            if scale is None:
                texts[label] = value.split(b"\0")[0].decode("latin-1")
            else:
                numbers[label] = value * scale if scale != 1 else float(value)
        return at + size, (at, name, numbers, texts)

    def starts(self, data: bytes, upto: int) -> list[int]:
        return list(range(upto))


def dataflash_formats(files: DataFrame, size: int = ranges.RANGE_BYTES) -> DataFrame:
    """(file, known) of the declarations in files (path, length): a format that is declared again the same is held once."""
    found = ranges.read_frames(files, lambda head, known: Declarations(), "number int, bytes int, name string, form string, labels string", size)
    format_of = F.struct("bytes", "name", "form", "labels")
    before = F.lag(format_of).over(Window.partitionBy("file", "number").orderBy("off"))
    changed = found.withColumn("changed", ~format_of.eqNullSafe(before)).filter("changed")
    return changed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("off", "number", "bytes", "name", "form", "labels"))).alias("known"))


def dataflash_messages(spark: SparkSession, path: str | list[str], size: int = ranges.RANGE_BYTES) -> DataFrame:
    """(file, off, msg, numbers, texts) of each message whose format the log has declared before."""
    files = listed(spark, path)
    return ranges.read_frames(files, lambda head, known: Dataflash(head, None if known is None else [tuple(d.values()) if isinstance(d, dict) else tuple(d) for d in known]), "msg string, numbers map<string,double>, texts map<string,string>", size, known=dataflash_formats(files, size))


def _first(*names: str):
    return F.coalesce(*[F.element_at("numbers", n) for n in names])


def dataflash_telemetry(messages: DataFrame) -> DataFrame:
    """GPS rows with absolute times, positions on the globe, and the last attitude before them."""
    rows = messages.filter(F.col("msg").isin("GPS", "ATT")).select(
        F.col("file").alias("case_id"), F.lit(0).alias("ingest_seq"), F.col("off").alias("seq"), "msg",
        _first("Lat").alias("latitude"), _first("Lng", "Lon").alias("longitude"), _first("Alt").alias("altitude_m"), _first("Spd").alias("ground_speed_mps"), _first("NSats").cast("int").alias("satellites_visible"),
        _first("GWk").alias("week"), _first("GMS").alias("week_ms"), _first("GCrs").alias("course"), _first("Roll").alias("roll_deg"), _first("Pitch").alias("pitch_deg"), _first("Yaw").alias("yaw_deg"),
    )
    held = carry_forward(stored(rows), ["roll_deg", "pitch_deg", "yaw_deg"])
    ts = F.timestamp_micros(((F.col("week") * WEEK_S + GPS_EPOCH_S) * 1_000_000 + F.col("week_ms") * 1000).cast("long"))
    good = (F.col("msg") == "GPS") & off_null_island(F.col("latitude"), F.col("longitude"), 0.001)
    return held.filter(good).select(
        F.col("case_id").alias("file"), "seq", F.when(F.col("week") > 0, ts).alias("ts"), "latitude", "longitude", "altitude_m", "ground_speed_mps", "satellites_visible", "roll_deg", "pitch_deg",
        F.coalesce(F.when(F.col("yaw_deg") != 0, F.col("yaw_deg")), "course", F.lit(0.0)).alias("yaw_deg"), F.lit("DATAFLASH_GPS").alias("source_channel"),
    )


#: Event ids of the log and what they mean.
EVENT_IDS = {10: "ARM", 11: "DISARM", 15: "ARM", 25: "FAILSAFE", 28: "TAKEOFF"}
MODES = {0: "STABILIZE", 1: "ACRO", 2: "ALT_HOLD", 3: "AUTO", 4: "GUIDED", 5: "LOITER", 6: "RTL", 7: "CIRCLE", 9: "LAND", 16: "POSHOLD", 17: "BRAKE", 21: "SMART_RTL"}


def mode_name(code: Column) -> Column:
    """The flight mode's name, MODE_n for others."""
    names = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])
    return F.coalesce(F.element_at(names, code.cast("int")), F.concat(F.lit("MODE_"), code.cast("int").cast("string")))


def dataflash_events(messages: DataFrame) -> DataFrame:
    """Events and mode changes with the last position before them."""
    ids = F.create_map(*[F.lit(x) for kv in EVENT_IDS.items() for x in kv])
    kind = F.when(F.col("msg") == "EV", F.element_at(ids, _first("Id").cast("int"))).when((F.col("msg") == "MODE") & (_first("ModeNum", "Mode") == 3), "WAYPOINT_REACHED")
    rows = messages.filter(F.col("msg").isin("GPS", "EV", "MODE")).select(
        F.col("file").alias("case_id"), F.lit(0).alias("ingest_seq"), F.col("off").alias("seq"), kind.alias("event_type"), F.when(F.col("msg") == "MODE", mode_name(_first("ModeNum", "Mode"))).alias("mode"),
        F.when(F.col("msg") == "GPS", _first("Lat")).alias("latitude"), F.when(F.col("msg") == "GPS", _first("Lng", "Lon")).alias("longitude"),
    )
    return carry_forward(stored(rows), ["latitude", "longitude"]).filter(F.col("event_type").isNotNull()).withColumnRenamed("case_id", "file").drop("ingest_seq")


#: What a log's messages say of its hardware, and what is assumed if they don't.
FIRMWARE, FRAME, BOARD = "ArduPilot", "Standard", "Pixhawk / STM32 Autopilot"


def dataflash_summary(messages: DataFrame, most: int = 50) -> DataFrame:
    """Per file: parameters (the first `most`, and how many there are), and firmware, frame and board as its messages name them last."""
    params = messages.filter("msg = 'PARM'").select("file", F.element_at("texts", "Name").alias("name"), _first("Value").alias("value"), "off").groupBy("file", "name").agg(F.min("off").alias("off"), F.max_by("value", "off").alias("value"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("off"))
    ranked = params.withColumn("k", place).groupBy("file").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("name", "value"))))).alias("params"), F.count("*").alias("params_total")
    )
    text = F.element_at("texts", "Message")
    last = lambda says, what: F.max_by(F.when(says, what), F.when(says, F.col("off")))
    told = messages.filter("msg = 'MSG'").groupBy("file").agg(
        last(text.contains("APM:") | text.contains("Ardu"), text).alias("firmware"),
        last(text.contains("Frame:"), F.trim(F.replace(text, F.lit("Frame:"), F.lit("")))).alias("frame"),
        last(text.contains("PX4v") | text.contains("Cube") | text.contains("Pixhawk"), text).alias("board"),
    )
    assumed = {"firmware": FIRMWARE, "frame": FRAME, "board": BOARD}
    return ranked.join(told, "file", "full_outer").select("file", "params", "params_total", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in assumed.items()])


# ---------------------------------------------------------------- radio logs

_LAYOUTS = {
    POSITION: (struct.Struct("<IiiiihhhH"), ("boot_ms", "lat", "lon", "alt", "rel_alt", "vx", "vy", "vz", "hdg")),
    RAW_GPS: (struct.Struct("<QiiiHHHHBB"), ("usec", "lat", "lon", "alt", "eph", "epv", "vel", "cog", "fix", "sats")),
    HOME: (struct.Struct("<iii"), ("lat", "lon", "alt")),
    HEARTBEAT: (struct.Struct("<IBBBBB"), ("custom_mode", "type", "autopilot", "base_mode", "status", "version")),
    TEXT: (struct.Struct("<B"), ("severity",)),
}


class Radio:
    """Framing of stamped radio logs; a damaged frame costs itself and what it hides."""

    first, longest = 0, 512

    def __init__(self, head: bytes = b"", known: object = None) -> None:
        pass

    @staticmethod
    def _begins(data: bytes, at: int) -> bool:
        return data[at + 8] in (0xFE, 0xFD) and STAMP_RANGE[0] <= int.from_bytes(data[at : at + 8], "big") <= STAMP_RANGE[1]

    def step(self, data: bytes, at: int, base: int) -> tuple[int | None, tuple | None]:
        end = len(data)
        if at + 16 > end:
            return None, None
        if not self._begins(data, at):
            return next((i for i in range(at + 1, min(at + RESYNC_BYTES, end - 8)) if self._begins(data, i)), at + RESYNC_BYTES), None
        stamp, size = int.from_bytes(data[at : at + 8], "big"), data[at + 9]
        if data[at + 8] == 0xFE:
            msg, start, tail = data[at + 13], at + 14, 2
        else:
            msg, start, tail = int.from_bytes(data[at + 15 : at + 18], "little"), at + 18, 2 + 13 * (data[at + 10] & 1)
        if start + size > end:
            return None, None
        after = start + size + tail
        if msg not in _LAYOUTS:
            return after, None
        packed, names = _LAYOUTS[msg]
        payload = data[start : start + size].ljust(packed.size + 50, b"\0")
        text = payload[1:51].split(b"\0")[0].decode("latin-1") if msg == TEXT else None
        return after, (at, stamp, msg, dict(zip(names, map(float, packed.unpack_from(payload)), strict=True)), text)

    def starts(self, data: bytes, upto: int) -> list[int]:
        return list(range(upto))


RADIO_FIELDS = "us long, msg_id int, numbers map<string,double>, text string"


def radio_messages(spark: SparkSession, path: str | list[str], size: int = ranges.RANGE_BYTES) -> DataFrame:
    """(file, off, us, msg_id, numbers, text) of the wanted messages."""
    return ranges.read_frames(listed(spark, path), Radio, RADIO_FIELDS, size)


def radio_telemetry(messages: DataFrame) -> DataFrame:
    """Positions in file order; a raw GPS row at the time of the position row kept before it is left out."""
    rows = messages.filter(F.col("msg_id").isin(POSITION, RAW_GPS)).select(
        "file", F.col("off").alias("seq"), "us", "msg_id", (_first("lat") / 1e7).alias("latitude"), (_first("lon") / 1e7).alias("longitude"),
        F.round(F.when(F.col("msg_id") == POSITION, _first("rel_alt")).otherwise(_first("alt")) / 1000, 2).alias("altitude_m"),
        F.round(F.when(F.col("msg_id") == POSITION, F.sqrt(_first("vx") * _first("vx") + _first("vy") * _first("vy"))).otherwise(_first("vel")) / 100, 2).alias("ground_speed_mps"),
        _first("sats").cast("int").alias("satellites_visible"),
    )
    good = rows.filter((F.abs("latitude") <= 90) & (F.abs("longitude") <= 180) & off_null_island(F.col("latitude"), F.col("longitude"), 0.001))
    good = previous(stored(good), F.struct("msg_id", "us"), "before", ["file"], ranges.by_offset("seq"), "seq")
    repeated = (F.col("msg_id") == RAW_GPS) & (F.col("before.msg_id") == POSITION) & (F.col("before.us") == F.col("us"))
    return good.withColumn("repeated", F.coalesce(repeated, F.lit(False))).filter("not repeated").select(
        "file", "seq", F.timestamp_micros("us").alias("ts"), "latitude", "longitude", "altitude_m", "ground_speed_mps", "satellites_visible", F.when(F.col("msg_id") == POSITION, "GLOBAL_POSITION_INT").otherwise("GPS_RAW_INT").alias("source_channel")
    )


def radio_events(messages: DataFrame) -> DataFrame:
    """Arm and disarm edges of heartbeats, and status texts by severity; failures by what they say."""
    messages = stored(messages.filter(F.col("msg_id").isin(HEARTBEAT, TEXT)))
    beats = messages.filter(F.col("msg_id") == HEARTBEAT).select(F.col("file").alias("case_id"), F.lit(0).alias("ingest_seq"), F.col("off").alias("seq"), "us", _first("base_mode").cast("int").alias("mode"))
    edges = arm_edges(beats, F.col("mode").bitwiseAND(ARMED_BIT) > 0).select(F.col("case_id").alias("file"), "seq", "us", "event_type", F.lit("INFO").alias("severity"), F.lit(None).cast("string").alias("description"))
    level = _first("severity")
    texts = messages.filter((F.col("msg_id") == TEXT) & (F.col("text") != "")).select(
        "file", F.col("off").alias("seq"), "us", F.when(F.col("text").rlike("(?i)failsafe|crash"), "FAILSAFE").otherwise("ERROR_ALERT").alias("event_type"),
        F.when(level <= 2, "CRITICAL").when(level <= 4, "WARNING").otherwise("INFO").alias("severity"), F.col("text").alias("description"),
    )
    return edges.unionByName(texts).withColumn("ts", F.timestamp_micros("us")).drop("us")


def radio_homes(messages: DataFrame) -> DataFrame:
    """Different home positions of a file."""
    return messages.filter(F.col("msg_id") == HOME).select("file", F.round(_first("lat") / 1e7, 7).alias("latitude"), F.round(_first("lon") / 1e7, 7).alias("longitude"), (_first("alt") / 1000).alias("altitude_m")).distinct()


# ---------------------------------------------------------------- captures

BRANDS = ("DJI-", "Spark-", "Mavic-", "Phantom-", "Bebop", "Anafi", "PX4", "Ardu")
MOST_PACKETS, MOST_MACS = 1000, 15


CAPTURE_HEAD, PACKET_HEAD, LEAST_SNAP = 24, 16, 262_144
#: First bytes of captures: those written with big-endian and with little-endian numbers.
CAPTURE_MARKS = (b"\xa1\xb2\xc3\xd4", b"\xd4\xc3\xb2\xa1")


class Capture:
    """Framing of packet captures: each packet's head tells where the next one begins.

    A packet that is longer than the capture's snap length (LEAST_SNAP at least), or than the
    file, ends the file. Numbers are little-endian, but in files with the other mark whose
    first packet can't be read so.
    """

    first = CAPTURE_HEAD

    def __init__(self, head: bytes) -> None:
        size, wire = struct.unpack_from("<II", head.ljust(CAPTURE_HEAD + PACKET_HEAD, b"\0"), CAPTURE_HEAD + 8)
        self.order = ">" if head[:4] == CAPTURE_MARKS[0] and (size > wire or size > LEAST_SNAP) else "<"
        self.snap = max(LEAST_SNAP, min(struct.unpack_from(self.order + "I", head, 16)[0], 1 << 24)) if len(head) >= CAPTURE_HEAD else LEAST_SNAP
        self.longest = PACKET_HEAD + self.snap
        self.head = struct.Struct(self.order + "IIII")

    def step(self, data: bytes, at: int, base: int) -> tuple[int | None, tuple | None]:
        if at + PACKET_HEAD > len(data):
            return None, None
        ts, _, size, _ = self.head.unpack_from(data, at)
        after = at + PACKET_HEAD + size
        if size > self.snap or after > len(data):
            return None, None
        return after, (at, ts, size, data[at + PACKET_HEAD : after])

    def starts(self, data: bytes, upto: int) -> list[int]:
        """Places whose next three packets are whole and no longer than what was on the wire."""
        raw = np.frombuffer(data, np.uint8)
        known = len(raw) - PACKET_HEAD + 1
        words = [sum(raw[8 + 4 * k + i : 8 + 4 * k + i + known].astype(np.int64) << (8 * (i if self.order == "<" else 3 - i)) for i in range(4)) for k in range(2)]
        fits = (words[0] <= self.snap) & (words[0] <= words[1])
        at = np.flatnonzero(fits[:upto])
        for _ in range(3):
            after = at + PACKET_HEAD + words[0][at]
            inside = after < known
            at = at[~inside | fits[np.minimum(after, known - 1)]]
        return at.tolist() + list(range(max(0, min(known, upto)), upto))


def _capture(head: bytes, known: object) -> Capture | None:
    return Capture(head) if head[:4] in CAPTURE_MARKS else None


def read_pcap(spark: SparkSession, path: str | list[str], most: int | None = MOST_PACKETS, size: int = ranges.RANGE_BYTES) -> DataFrame:
    """(file, off, n, ts_sec, size, payload) of the first `most` packets of each capture file, all of them if None."""
    found = ranges.read_frames(listed(spark, path), _capture, "ts_sec long, size long, payload binary", size, head=CAPTURE_HEAD + PACKET_HEAD, ends=True)
    return (found if most is None else found.filter(F.col("n") < most)).select("file", "off", "n", "ts_sec", "size", "payload")


def pcap_summary(packets: DataFrame) -> DataFrame:
    """Per file: packets, those with a telemetry marker byte, network names of known brands, and the first source addresses to come."""
    text = F.decode("payload", "ISO-8859-1")
    name = lambda brand: F.regexp_replace(F.split(F.substring(F.regexp_extract(text, rf"(?s)({brand}.{{0,32}})", 1), 1, 32), "\x00")[0], "[^ -~]", "")
    named = F.array_remove(F.array_distinct(F.array(*map(name, BRANDS))), "")
    source = F.regexp_replace(F.lower(F.hex(F.substring("payload", 7, 6))), r"(..)(?=.)", "$1:")
    rows = packets.select("file", "off", text.rlike("[þý]").alias("marked"), named.alias("named"), F.when(F.octet_length("payload") >= 14, source).alias("mac"))
    by_mac = rows.groupBy("file", "mac").agg(F.count("*").alias("packets"), F.count_if("marked").alias("marked"), F.array_distinct(F.flatten(F.collect_set("named"))).alias("ssids"), F.min("off").alias("off"))
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.col("mac").isNull(), "off"))
    first = by_mac.withColumn("mac", F.when(place <= MOST_MACS, F.col("mac")))
    return first.groupBy("file").agg(
        F.sum("packets").alias("packets"),
        F.sum("marked").alias("telemetry_frames"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ssids")))).alias("ssids"),
        F.array_sort(F.collect_set("mac")).alias("macs"),
    )


# ---------------------------------------------------------------- carving and media times

MIB = 1 << 20
#: Kind, header, its offset in the file, footer, greatest and default size.
SIGNATURES = (
    ("JPEG_PHOTO", b"\xff\xd8\xff", 0, b"\xff\xd9", 25 * MIB, MIB),
    ("PNG_IMAGE", b"\x89PNG\r\n\x1a\n", 0, b"IEND\xaeB`\x82", 15 * MIB, MIB),
    ("MP4_VIDEO", b"ftyp", 4, None, 20 * MIB, 50 * MIB),
    ("PX4_ULOG", b"ULog\x01\x12\x35", 0, None, 20 * MIB, 10 * MIB),
    ("ARDUPILOT_DATAFLASH", b"\xa3\x95", 0, None, 20 * MIB, 15 * MIB),
)
MOST_CARVES = 50
#: Bytes that are read at once for extents that are no longer.
NEAR_BYTES = 64 * 1024


def _places(data: bytes, pattern: bytes) -> list[int]:
    found, at = [], data.find(pattern)
    while at >= 0:
        found.append(at)
        at = data.find(pattern, at + 1)
    return found


def header_places(read: Callable[[int, int], bytes], header: bytes, start: int, stop: int, length: int) -> list[int]:
    """Places of a header in a range: found from the file's start on, each search going on one byte behind the last find.

    A find with none in the bytes before it that a find could hide is always one, so the search
    needs to go back only to the last such find.
    """
    apart, back = len(header) + 1, 64 * len(header)
    while True:
        low = max(0, start - back)
        every = _places(read(low, min(length, stop + len(header) - 1)), header)
        free = low == 0
        kept: list[int] = []
        for i, at in enumerate(every):
            alone = (at >= apart or low == 0) if i == 0 else at - every[i - 1] >= apart
            free = free or (alone and low + at <= start)
            if free and (not kept or at - kept[-1] >= apart):
                kept.append(at)
            elif not free and low + at >= start and alone:
                free = True
                kept.append(at)
            elif not free and low + at >= start:
                break
        else:
            return [low + at for at in kept if start <= low + at < stop]
        back *= 8


def _signature_marks(files: DataFrame, size: int) -> DataFrame:
    """(file, length, rank, off, footer) of every header and footer in files (path, length)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with ranges.open_file(row.file) as opened:
                    read = ranges.reading(opened)
                    for rank, (_, header, _, footer, _, _) in enumerate(SIGNATURES):
                        heads, feet = [], []
                        for start in range(row.start, row.stop, size):
                            stop = min(row.stop, start + size)
                            heads += header_places(read, header, start, stop, row.length)
                            feet += [start + at for at in _places(read(start, min(row.length, stop + len(footer) - 1)), footer)] if footer else []
                        off = np.array(heads + feet, np.int64)
                        yield pd.DataFrame({"file": row.file, "length": row.length, "rank": rank, "off": off, "footer": np.arange(len(off)) >= len(heads)})

    return ranges.stretches(files, size).mapInPandas(run, "file string, length long, rank int, off long, footer boolean")


def carve_extents(spark: SparkSession, path: str | list[str], most: int | None = MOST_CARVES, size: int = ranges.RANGE_BYTES) -> DataFrame:
    """(file, carve_id, file_type, byte_offset, size_bytes): headers with the next footer within the greatest size, else the default size.

    Marks are found by byte ranges; a header's next footer is carried backwards over stretches of
    the file. The first `most` extents of a file, by signature and place, are given; all if None.
    """
    marks = stored(_signature_marks(listed(spark, path), size))
    kinds = spark.createDataFrame([(i, k, len(h), o, 0 if f is None else len(f), g, d) for i, (k, h, o, f, g, d) in enumerate(SIGNATURES)], "rank int, file_type string, header_len int, header_off int, footer_len int, greatest long, default_len long")
    carried = with_last(marks, {"next": F.when(F.col("footer"), F.col("off"))}, ["file", "rank"], ranges.by_offset(), ["off", "footer"], descending=True)
    paired = carried.filter("not footer").join(F.broadcast(kinds), "rank")
    start = F.greatest(F.lit(0), F.col("off") - F.col("header_off"))
    closed = (F.col("next") >= F.col("off") + F.col("header_len")) & (F.col("next") - start + F.col("footer_len") <= F.col("greatest"))
    finish = F.when(F.coalesce(closed, F.lit(False)), F.col("next") + F.col("footer_len")).otherwise(F.least(F.col("length"), start + F.col("default_len")))
    sized = paired.select("file", "rank", "file_type", start.alias("byte_offset"), (finish - start).alias("size_bytes"), "header_len").filter(F.col("size_bytes") > F.col("header_len"))
    if most is None:
        ordered = numbered(sized, "carve_id", ["file"], {"_rank": F.col("rank"), **ranges.by_offset("byte_offset")}, ["byte_offset"])
    else:
        ordered = sized.withColumn("carve_id", F.row_number().over(Window.partitionBy("file").orderBy("rank", "byte_offset"))).filter(F.col("carve_id") <= most)
    return ordered.select("file", "carve_id", "file_type", "byte_offset", "size_bytes")


def hash_extents(spark: SparkSession, extents: DataFrame) -> DataFrame:
    """extents with the SHA-256 and MD5 of their bytes, read a few MiB at a time.

    A task takes extents in the order of their files and places: it opens a file once, and short
    extents that stand close are taken from the bytes that are at hand.
    """

    def digest(read: Callable[[int, int], bytes], at: int, left: int) -> tuple[str, str]:
        both = (hashlib.sha256(), hashlib.md5(usedforsecurity=False))
        while left > 0 and (part := read(at, at + min(left, 4 * MIB))):
            at, left = at + len(part), left - len(part)
            for h in both:
                h.update(part)
        return both[0].hexdigest(), both[1].hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, opened, low, held = None, None, 0, b""
        for batch in batches:
            digests = []
            for file, at, size in zip(batch["file"], batch["byte_offset"], batch["size_bytes"], strict=True):
                if file != name:
                    if opened is not None:
                        opened.close()
                    name, opened, low, held = file, ranges.open_file(file), 0, b""
                    read = ranges.reading(opened)
                if size > NEAR_BYTES:
                    digests.append(digest(read, at, size))
                    continue
                if at < low or at + size > low + len(held):
                    low, held = at, read(at, at + NEAR_BYTES)
                digests.append(digest(lambda a, b: held[a - low : b - low], at, size))
            yield batch.assign(sha256=[d[0] for d in digests], md5=[d[1] for d in digests])
        if opened is not None:
            opened.close()

    kinds = ", ".join(f"{name} {kind}" for name, kind in extents.dtypes)
    dealt = extents.repartition("file", F.floor(F.col("byte_offset") / ranges.TASK_BYTES)).sortWithinPartitions("file", "byte_offset")
    return dealt.mapInPandas(run, f"{kinds}, sha256 string, md5 string")


MEDIA_EPOCH_S = 2_082_844_800
HALF_MIB = 512 * 1024
#: Boxes that hold the boxes that lead to the movie header.
MOVIE, MOVIE_HEADER = b"moov", b"mvhd"


def movie_header(read: Callable[[int, int], bytes], length: int) -> bytes | None:
    """The content of a file's movie header, by walking the box tree from head to head; else by its name in the first or last half MiB."""
    at, stop = 0, length
    while at + 8 <= stop:
        head = read(at, min(stop, at + 16))
        size, name, body = int.from_bytes(head[:4], "big"), head[4:8], 8
        if size == 1 and len(head) == 16:
            size, body = int.from_bytes(head[8:], "big"), 16
        size = size or stop - at
        if size < body or at + size > stop:
            break
        if name == MOVIE_HEADER:
            return read(at + body, min(at + size, at + body + 112))
        if name == MOVIE:
            at, stop = at + body, at + size
        else:
            at += size
    for low in (0, max(0, length - HALF_MIB)):
        found = (part := read(low, min(length, low + HALF_MIB))).find(MOVIE_HEADER)
        if found >= 0:
            return part[found + 4 : found + 116]
    return None


def read_container_times(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, created, duration_sec) of files with a movie header; only heads of boxes and the header are read."""
    files = listed(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                with ranges.open_file(row.path) as opened:
                    def read(a: int, b: int, opened=opened) -> bytes:
                        opened.seek(a)
                        return opened.read(max(0, b - a))

                    header = movie_header(read, row.length)
                if header is None or len(header) < 32:
                    continue
                created, _, scale, length = struct.unpack_from(">QQIQ" if header[0] == 1 else ">IIII", header, 4)
                rows.append((row.path, created, scale, length))
            yield pd.DataFrame(rows, columns=["file", "created", "scale", "units"])

    found = files.repartition(max(1, min(files.count(), ranges.MOST_TASKS))).mapInPandas(run, "file string, created long, scale long, units long")
    return found.select("file", F.when(F.col("created") > MEDIA_EPOCH_S, F.timestamp_seconds(F.col("created") - MEDIA_EPOCH_S)).alias("created"), F.when(F.col("scale") > 0, F.col("units") / F.col("scale")).alias("duration_sec"))
