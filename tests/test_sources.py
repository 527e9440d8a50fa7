"""Readers over small files written here in the formats' shapes."""

from __future__ import annotations

import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flightlens.operators import evidence
from flightlens.sources import binary, flight_logs, lines, missions, zones


@pytest.fixture
def files(tmp_path):
    def write(**contents):
        for name, content in contents.items():
            path = tmp_path / name.replace("__", ".")
            path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return f"file://{tmp_path}"

    return write


def rows(df, *columns, order="seq"):
    return [tuple(r[c] for c in columns) for r in df.orderBy(order).collect()]


def test_srt_blocks(spark, files):
    block = "{n}\n00:00:0{n},000 --> 00:00:0{m},000\nHOME(72.9,19.1) 2026-09-13 10:00:0{n}\nGPS(72.91{n}, 19.13{n}, 1{n}) ISO:100 Shutter:1/50 Fnum:2.8 [latitude: 19.13{n}] [longitude: 72.91{n}] [altitude: {n}.5] [hspeed: 2.1] [pitch: -1.0] [yaw: 45.0]"
    path = files(a__srt="\n\n".join(block.format(n=n, m=n + 1) for n in range(1, 5)) + "\n\n9\nshort\n\n5\nx\nno position here\n")
    found = rows(flight_logs.read_srt(spark, path), "seq", "ts", "latitude", "longitude", "altitude_m", "ground_speed_mps", "pitch_deg")
    assert found == [(n - 1, datetime(2026, 9, 13, 10, 0, n), round(19.13 + n / 1000, 3), round(72.91 + n / 1000, 3), n + 0.5, 2.1, -1.0) for n in range(1, 5)]
    frames = flight_logs.read_srt_frames(spark, path).orderBy("frame_index").collect()
    assert [(r.frame_index, r.latitude, r.longitude, r.altitude_m, r.camera_settings.iso) for r in frames][0] == (1, 19.131, 72.911, 11.0, "100")


def test_flight_csv_finds_columns_and_turns_feet(spark, files):
    text = "sep=,\nCUSTOM.date,CUSTOM.updateTime,OSD.latitude,OSD.longitude,OSD.height [ft],OSD.hSpeed [MPH],OSD.battery\n2024-01-01,10:00:00,19.1,72.9,100,5.123,90\n2024-01-01,10:00:01,0.0,0.0,1,1,1\n2024-01-01,10:00:02,19.2,72.8,,x,\n"
    found = rows(flight_logs.read_flight_csv(spark, files(a__csv=text)), "seq", "ts", "latitude", "altitude_m", "ground_speed_mps", "battery_pct")
    assert found == [(0, datetime(2024, 1, 1, 10), 19.1, 30.48, 5.12, 90.0), (1, datetime(2024, 1, 1, 10, 0, 2), 19.2, 0.0, 0.0, None)]


def test_dat_text(spark, files):
    found = rows(flight_logs.read_dat_text(spark, files(a__dat="OSD latitude=19.1 longitude=72.9 alt=5\nnothing\nlat: 19.2 lon: 72.8\n")), "latitude", "longitude", "altitude_m")
    assert found == [(19.1, 72.9, 5.0), (19.2, 72.8, 10.0)]


AP = """FMT, 128, 45, GPS, QBIHBcLLeffff, TimeUS,Status,GMS,GWk,NSats,HDop,Lat,Lng,Alt,Spd,GCrs,VZ,Yaw
FMT, 129, 31, POS, QLLfff, TimeUS,Lat,Lng,Alt,RelHomeAlt,RelOriginAlt
PARM, 1000000, BATT_CAPACITY, 5200
MODE, 1000000, STABILIZE, 0, 1
EV, 1200000, 10
GPS, 3, 1500000, 200, 14, 0.8, 19.1334000, 72.9133000, 15.0, 1.2, 45.0, 1.5, 45.0
POS, 1500000, 191334000, 729133000, 15.0, 5.0, 5.0
MODE, 2000000, AUTO, 3, 1
GPS, 1, 2, 3, 4, 14, 0.7, 191345000, 729142000, 35.0, 5.5, 48.0, 2.0, 48.0
EV, 2600000, 25
"""


def test_ascii_log_by_declared_fields_and_by_search(spark, files):
    path = files(a__log=AP, b__log="FMT, 129, 31, POS, QLLfff, TimeUS,Lat,Lng,Alt,RelHomeAlt,RelOriginAlt\nPOS, 1, 191334000, 729133000, 15.0, 5.0, 5.0\n")
    found = flight_logs.read_ap_log(spark, path, "2024-01-01 00:00:00")
    a = rows(found.filter(F.col("file").endswith("a.log")), "latitude", "longitude", "altitude_m", "ground_speed_mps", "satellites_visible")
    assert a == [(19.1334, 72.9133, 15.0, 0.0, None), (19.1345, 72.9142, 35.0, 5.5, 14)]
    assert rows(found.filter(F.col("file").endswith("b.log")), "latitude", "altitude_m") == [(19.1334, 15.0)]
    events = rows(flight_logs.read_ap_events(spark, path).filter(F.col("file").endswith("a.log")), "event_type", "severity", "altitude_m")
    assert events == [("ARM", "INFO", 0.0), ("WAYPOINT_REACHED", "INFO", 15.0), ("FAILSAFE", "CRITICAL", 15.0), ("DISARM", "INFO", 0.0)]


def test_params_of_several_shapes(spark, files):
    path = files(a__param="# c\nA,1\nB=2\nC\t3\nPARM, 100, D, 4\nPARM, E, 5\n", b__param="".join(f"P{i},{i}\n" for i in range(80)))
    found = {r.file[-7]: (r.params, r.total) for r in flight_logs.read_params(spark, path).collect()}
    assert found["a"][0] == {"A": "1", "B": "2", "C": "3", "D": "4", "E": "5"}
    assert len(found["b"][0]) == 51 and found["b"][1] == 80 and "P50" in found["b"][0]


def test_px4_table_and_json_dump(spark, files):
    path = files(a__csv="timestamp,lat,lon,alt,vel_m_s,satellites_used\n1,191334000,729133000,52000,0.8,14\n2,0,0,1,1,1\n3,19.2,72.8,7,1,x\n")
    found = rows(flight_logs.read_px4_csv(spark, path, "2024-01-01 00:00:00"), "seq", "ts", "latitude", "altitude_m", "satellites_visible")
    assert found == [(0, datetime(2024, 1, 1), 19.1334, 52.0, 14), (1, datetime(2024, 1, 1, 0, 0, 1), 19.2, 7.0, None)]


def test_json_dump(spark, files):
    text = 'junk {"product_name":"P","serial_number":"S1","date":"2026-09-13T10:30:00Z","details":[{"timestamp_utc":"2026-09-13T10:30:01Z","latitude":19.1,"longitude":72.9,"altitude":1.5,"speed":0.2,"battery_level":98},{"lat":500.0,"lon":500.0},{"lat":19.2,"lon":72.8,"alt":3}]}'
    path = files(a__json=text)
    assert rows(flight_logs.read_parrot_json(spark, path), "ts", "latitude", "altitude_m", "battery_pct") == [(datetime(2026, 9, 13, 10, 30, 1), 19.1, 1.5, 98.0), (datetime(2026, 9, 13, 10, 30), 19.2, 3.0, None)]
    assert missions.read_freeflight_serials(spark, path).first().serial == "S1"


def test_blackbox(spark, files):
    path = files(a__txt="H Product:Blackbox\nH Craft name:X\nE,0,ARMED\nG,1000000,12,19.1334000,72.9133000,5.0,1.2,45.0\nG,2,191345000,729142000,30.0,12.5\nG,3,0,0,0,0\nE,9,DISARMED\nE,7,OTHER\nset a = b\n")
    assert rows(flight_logs.read_blackbox(spark, path), "latitude", "longitude", "altitude_m", "ground_speed_mps", "satellites_visible") == [(19.1334, 72.9133, 5.0, 1.2, 12), (19.1345, 72.9142, 30.0, 12.5, None)]
    assert rows(flight_logs.read_blackbox_events(spark, path), "event_type") == [("ARM",), ("DISARM",)]
    assert flight_logs.read_blackbox_config(spark, path).first().config == {"Product": "Blackbox", "Craft name": "X", "a": "b"}


def test_tabular_waypoints(spark, files):
    path = files(a__waypoints="QGC WPL 110\n0\t1\t0\t16\t0\t0\t0\t0\t19.1\t72.9\t15\t1\n1\t0\t3\t22\t0\t0\t0\t0\t19.2\t72.8\t35.123\t1\n2\t0\t3\t999\t0\t0\t0\t0\t0\t0\t0\t1\n", b__waypoints="0 1 0 16 0 0 0 0 1 1 1 1\n")
    found = missions.read_wpl(spark, path)
    assert rows(found, "idx", "command", "latitude", "altitude_m", order="idx") == [(0, "HOME", 19.1, 15.0), (1, "TAKEOFF", 19.2, 35.12), (2, "MAV_CMD_999", 0.0, 0.0)]
    assert missions.home_locations(found, "WPL").first().latitude == 19.1


def test_plan_with_fences(spark, files):
    text = '{"fileType":"Plan","groundStation":"QGroundControl","mission":{"plannedHomePosition":[19.1,72.9,5.2],"cruiseSpeed":10.0,"items":[{"command":16,"params":[0,0,0,null,19.2,72.8,22.0]},{"command":21,"params":[]}]},"geoFence":{"polygons":[{"polygon":[[1,1],[1,2],[2,2]],"inclusion":true},{"polygon":[[1,1],[1,2],[2,2]]},{"polygon":[]}]}}'
    path = files(a__plan=text)
    assert rows(missions.read_qgc_plan(spark, path), "idx", "command", "latitude", "altitude_m", "speed_mps", order="idx") == [(0, "HOME", 19.1, 5.2, None), (1, "WAYPOINT", 19.2, 22.0, 10.0), (2, "LAND", 0.0, 0.0, 10.0)]
    assert rows(missions.read_plan_fences(spark, path), "zone_id", "zone_class", order="zone_id") == [("QGC-FENCE-1", "YELLOW"), ("QGC-FENCE-2", "RED")]


def test_placemarks(spark, files):
    text = '<kml xmlns:wpml="w"><Placemark><Point><coordinates> 72.9,19.1 </coordinates></Point><wpml:executeHeight>60</wpml:executeHeight></Placemark><Placemark><coordinates>72.8,19.2,33</coordinates><wpml:waypointSpeed>7.5</wpml:waypointSpeed></Placemark><Placemark><name>n</name></Placemark></kml>'
    assert rows(missions.read_wpml(spark, files(a__kml=text)), "idx", "latitude", "longitude", "altitude_m", "speed_mps", order="idx") == [(1, 19.1, 72.9, 60.0, 10.0), (2, 19.2, 72.8, 33.0, 7.5)]


def test_json_and_text_missions(spark, files):
    path = files(a__json='{"mission":{"waypoints":[{"lat":19.1,"lng":72.9},{"latitude":19.2,"longitude":72.8,"altitude":5,"speed":1}]},"home_location":{"lat":1.5,"lon":2.5}}')
    assert rows(missions.read_gspro(spark, path), "latitude", "altitude_m", "speed_mps", order="idx") == [(19.1, 30.0, 8.0), (19.2, 5.0, 1.0)]
    assert missions.json_homes(spark, path).first().latitude == 1.5


def test_mission_texts(spark, files):
    path = files(a__mission="# c\n1 16 19.1 72.9 5.0 2.0 0 0 0 1\n2,rth,19.2,72.8\n3 0 3 22 0 0 0 0 19.3 72.7 9 1\nbad\n")
    assert rows(missions.read_inav_mission(spark, path), "idx", "command", "latitude", "altitude_m", "speed_mps", order="idx") == [(1, "WAYPOINT", 19.1, 5.0, 2.0), (2, "RTH", 19.2, 30.0, 15.0), (3, "TAKEOFF", 19.3, 9.0, 15.0)]


def test_mission_xml(spark, files):
    path = files(a__xml='<mission><missionitem no="1" action="WAYPOINT" lat="19.1" lon="72.9" alt="50"/><missionitem action="rth" lat="0" lon="0"/></mission>')
    assert rows(missions.read_inav_xml(spark, path), "command", "latitude", "altitude_m", order="idx") == [("WAYPOINT", 19.1, 50.0), ("RTH", 0.0, 30.0)]


def test_phone_logs_prefer_the_phone(spark, files):
    path = files(a__csv="latitude,longitude,altitude(m),datetime(utc),speed(m/s),phone_latitude,phone_longitude,home_latitude,home_longitude\n19.1,72.9,5,2024-01-01 10:00:00,1,,,19.0,72.0\n19.2,72.8,6,2024-01-01 10:00:01,2,19.05,72.05,19.0,72.0\n0,0,1,x,1,,,,\n")
    track, homes = missions.read_litchi_csv(spark, path)
    assert rows(track, "latitude", "altitude_m") == [(19.1, 5.0), (19.2, 6.0)]
    assert rows(homes, "latitude", "source", order="file") == [(19.05, "PHONE_GPS")]
    assert missions.read_litchi_mission(spark, path).count() == 3


def test_cli_config_and_dump(spark, files):
    path = files(a__txt="# Betaflight / STM32F405 4.4.2\nname Hawk\nset callsign = VT-X\nset a=1\nset a = 2\nDJI and PX4 seen\n")
    assert missions.read_cli_config(spark, path).first().config == {"firmware": "Betaflight / STM32F405 4.4.2", "craft_name": "Hawk", "callsign": "VT-X", "a": "2"}
    dump = missions.read_text_dump(spark, path).first()
    assert (dump.lines, dump.brands) == (6, ["DJI", "PX4"])


def test_autel_and_phone_records(spark, files):
    path = files(a__csv="sn,lat,lon,alt,speed,battery,time,pilot_lat,pilot_lon\n,19.1,72.9,5,1,90,2024-01-01T10:00:00Z,19.0,72.0\nA7,19.2,72.8,6,1,80,2024-01-01T10:00:01Z,19.0,72.0\n")
    track, homes, serials = missions.read_autel_csv(spark, path)
    assert track.count() == 2 and homes.first().source == "PILOT_GPS" and serials.first().serial == "A7"
    track, homes, _ = missions.read_mobile_flight_txt(spark, path, most=1)
    assert track.count() == 1 and homes.count() == 0


def test_times(spark):
    texts = ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00.5+00:00", "2024:01:01 10:00:00", "2024-01-01 10:00:00", "2024/01/01 10:00:00", "nonsense", None]
    found = [r.t for r in spark.createDataFrame([(t,) for t in texts], "raw string").select(lines.parse_ts(F.col("raw")).alias("t")).collect()]
    base = datetime(2024, 1, 1, 10)
    assert found == [base, base + timedelta(milliseconds=500), base, base, base, None, None]


def dataflash(name, number, form, labels, values=None):
    packed = "<" + "".join(binary.FORMATS[c][0] for c in form)
    if values is None:
        return b"\xa3\x95\x80" + struct.pack("<BB4s16s64s", number, struct.calcsize(packed) + 3, name.encode(), form.encode(), labels.encode())
    return b"\xa3\x95" + bytes([number]) + struct.pack(packed, *values)


def test_dataflash(spark, files):
    gps, att, ev, parm, msg = ("GPS", 130, "QBIHBLLef", "TimeUS,Status,GMS,GWk,NSats,Lat,Lng,Alt,Spd"), ("ATT", 131, "Qccc", "TimeUS,Roll,Pitch,Yaw"), ("EV", 132, "QB", "TimeUS,Id"), ("PARM", 133, "QNf", "TimeUS,Name,Value"), ("MSG", 134, "QZ", "TimeUS,Message")
    data = b"".join(dataflash(*m) for m in (gps, att, ev, parm, msg))
    data += dataflash(*gps, (1, 3, 1000, 2300, 9, 0, 0, 0, 0.0)) + dataflash(*ev, (1, 10)) + dataflash(*att, (2, 150, -250, 9000)) + b"noise\xa3"
    data += dataflash(*gps, (3, 3, 2000, 2300, 12, 191334000, 729133000, 1550, 2.5)) + dataflash(*ev, (4, 11)) + dataflash(*parm, (5, b"FENCE", 1.5)) + dataflash(*msg, (6, b"ArduCopter V4.3.1")) + b"\xa3\x95\x82short"
    messages = binary.dataflash_messages(spark, files(a__bin=data))
    row = binary.dataflash_telemetry(messages).collect()
    assert len(row) == 1 and (round(row[0].latitude, 7), row[0].altitude_m, row[0].roll_deg, row[0].pitch_deg, row[0].yaw_deg, row[0].satellites_visible) == (19.1334, 15.5, 1.5, -2.5, 90.0, 12)
    assert row[0].ts == datetime(1980, 1, 6) + timedelta(weeks=2300, seconds=2)
    assert rows(binary.dataflash_events(messages), "event_type") == [("ARM",), ("DISARM",)]
    told = binary.dataflash_summary(messages).first()
    assert (told.params, told.params_total, told.firmware) == ({"FENCE": 1.5}, 1, "ArduCopter V4.3.1")


def radio(us, msg, payload, version=1):
    if version == 1:
        return us.to_bytes(8, "big") + bytes([0xFE, len(payload), 0, 1, 1, msg]) + payload + b"\0\0"
    return us.to_bytes(8, "big") + bytes([0xFD, len(payload), 0, 0, 0, 1, 1]) + msg.to_bytes(3, "little") + payload + b"\0\0"


def test_radio_log(spark, files):
    us = 1_700_000_000_000_000
    position = struct.pack("<IiiiihhhH", 1, 191334000, 729133000, 99000, 15500, 300, 400, 0, 0)
    raw = struct.pack("<QiiiHHHHBB", 1, 191334000, 729133000, 16000, 0, 0, 250, 0, 3, 11)
    beat = lambda mode: struct.pack("<IBBBBB", 0, 2, 3, mode, 4, 3)
    data = radio(us, 0, beat(0)) + radio(us + 1, 33, position) + radio(us + 1, 24, raw) + b"broken" + radio(us + 2, 24, raw.rstrip(b"\0"), 2) + radio(us + 3, 0, beat(128)) + radio(us + 4, 253, bytes([2]) + b"Failsafe on".ljust(50, b"\0")) + radio(us + 5, 0, beat(0)) + radio(us + 6, 242, struct.pack("<iii", 190000000, 720000000, 5000)) + b"\0" * 9
    messages = binary.radio_messages(spark, files(a__tlog=data))
    assert rows(binary.radio_telemetry(messages), "source_channel", "latitude", "altitude_m", "ground_speed_mps", "satellites_visible") == [("GLOBAL_POSITION_INT", 19.1334, 15.5, 5.0, None), ("GPS_RAW_INT", 19.1334, 16.0, 2.5, 11)]
    assert rows(binary.radio_events(messages), "event_type", "severity") == [("ARM", "INFO"), ("FAILSAFE", "CRITICAL"), ("DISARM", "INFO")]
    assert binary.radio_homes(messages).first().latitude == 19.0


def test_capture(spark, files):
    packet = b"\x01\x02\x03\x04\x05\x06" + b"\xaa\xbb\xcc\xdd\xee\xff" + b"\x08\x00" + b"xxDJI-Mavic\x00tail" + b"\xfd\x01"
    other = b"\x00" * 20
    data = b"\xa1\xb2\xc3\xd4" + b"\0" * 20 + b"".join(struct.pack("<IIII", i, 0, len(p), len(p)) + p for i, p in enumerate([packet, other])) + struct.pack("<IIII", 3, 0, 99, 99) + b"cut"
    path = files(a__pcap=data, b__pcap=b"text")
    row = binary.pcap_summary(binary.read_pcap(spark, path)).collect()
    assert [(r.packets, r.telemetry_frames, r.ssids, r.macs) for r in row] == [(2, 1, ["DJI-Mavic"], ["00:00:00:00:00:00", "aa:bb:cc:dd:ee:ff"])]
    assert binary.read_pcap(spark, path, 1).count() == 1


def test_carving(spark, files):
    jpeg = b"\xff\xd8\xff\xe0" + b"J" * 200 + b"\xff\xd9"
    data = b"\0" * 4096 + jpeg + b"\0" * 100 + b"\0\0\0\x18ftypisom" + b"\0" * 50 + b"ULog\x01\x12\x35" + b"U" * 30
    path = files(disk__raw=data)
    found = binary.carve_extents(spark, path).orderBy("carve_id").collect()
    assert [(r.carve_id, r.file_type, r.byte_offset) for r in found] == [(1, "JPEG_PHOTO", 4096), (2, "MP4_VIDEO", 4096 + len(jpeg) + 100), (3, "PX4_ULOG", len(data) - 37)]
    assert found[0].size_bytes == len(jpeg) and found[2].size_bytes == 37
    import hashlib

    assert binary.hash_extents(spark, binary.carve_extents(spark, path)).filter("carve_id = 1").first().sha256 == hashlib.sha256(jpeg).hexdigest()


@pytest.mark.parametrize("wide", [False, True])
def test_container_times(spark, files, wide):
    created = int((datetime(2024, 1, 1) - datetime(1904, 1, 1)).total_seconds())
    head = (b"\x01\0\0\0" + struct.pack(">QQIQ", created, created, 1000, 12500)) if wide else (b"\0\0\0\0" + struct.pack(">IIII", created, created, 1000, 12500))
    path = files(a__mp4=b"\0" * 300 + b"mvhd" + head + b"\0" * 40, b__mp4=b"\0" * 100)
    row = binary.read_container_times(spark, path).collect()
    assert [(r.created, r.duration_sec) for r in row] == [(datetime(2024, 1, 1), 12.5)]


def test_scan_and_route(spark, files):
    path = files(a__srt="GPS(1,2,3)", b__bin=b"\xa3\x95\x80")
    scanned = binary.scan_evidence(spark, path).orderBy("name").collect()
    assert [(r.name, r.byte_count) for r in scanned] == [("a.srt", 10), ("b.bin", 3)]
    routed = binary.read_files(spark, path).withColumn("head", evidence.head_text(F.col("content"))).select("path", evidence.detect_platform(F.col("path"), F.col("head")).alias("p"))
    assert {r.path[-5:]: r.p for r in routed.collect()} == {"a.srt": "dji", "b.bin": "ardupilot"}


def test_zone_catalog_from_a_table(spark, tmp_path):
    zones.zone_catalog(spark).write.parquet(f"file://{tmp_path}/zones")
    assert zones.zone_catalog(spark, f"file://{tmp_path}/zones").count() == 42


def test_headers_and_operator_positions_need_no_sort_of_lines(spark, tmp_path):
    """The first header and position of a file, with blocks in between; only a few rows a block are ordered."""
    lines = ["", "sep=,", "latitude,longitude,phone_latitude,phone_longitude,home_latitude,home_longitude", "1,2,,,7,8", "1,2,0,0,7,9"] + [f"1,2,{3 + i % 50}.5,4,7,8" for i in range(4_000)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "b.csv").write_text("\n".join([lines[2], "1,2,,,5,6", "1,2,,,7,8"]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        track, homes = missions.read_litchi_csv(spark, f"file://{tmp_path}")
        assert sorted((r.file[-5:], r.latitude, r.longitude, r.source) for r in homes.collect()) == [("a.csv", 3.5, 4.0, "PHONE_GPS"), ("b.csv", 5.0, 6.0, "HOME_POINT")]
        assert track.count() == 4_004
        sorted_by_lines = [line for line in homes._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line and "line" in line]
        assert not sorted_by_lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
