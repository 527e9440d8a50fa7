"""Exports of tracks and cases: as texts, one row per case, or as files of any length; table writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.functions.geo import fixed
from flightlens.operators.places import with_place


def _track(telemetry: DataFrame, row: Column) -> DataFrame:
    """Per case its rows in list order; a case's track has to fit one row, as its export has to fit one text."""
    return telemetry.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ingest_seq", "seq", row.alias("r")))), lambda x: x["r"]).alias("rows"))


def _with_cases(track: DataFrame, cases: DataFrame | None) -> DataFrame:
    return track if cases is None else cases.select("case_id").distinct().join(track, "case_id", "left")


def to_geojson(telemetry: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(case_id, geojson): the path and its first and last point; a case without rows has no features."""
    row = F.struct(F.array("longitude", "latitude", "altitude_m").alias("at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    rows = F.col("rows")
    feature = lambda geometry, properties: F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}"))
    line = feature(
        F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(rows, lambda r: r["at"]).alias("coordinates"))),
        F.to_json(F.struct(F.lit("UAV Flight Trajectory").alias("name"), F.size(rows).alias("points_count"))),
    )
    point = lambda r, name: feature(F.to_json(F.struct(F.lit("Point").alias("type"), r["at"].alias("coordinates"))), F.to_json(F.struct(F.lit(name).alias("name"), r["ts"].alias("timestamp"))))
    features = F.concat_ws(",", line, point(F.get(rows, F.lit(0)), "Takeoff / Origin"), point(F.element_at(rows, -1), "Final Position / Landing"))
    body = F.when(F.size(rows) > 0, features).otherwise("")
    return _with_cases(_track(telemetry, row), cases).select("case_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))


def to_kml(telemetry: DataFrame, title: str = "UAV Flight") -> DataFrame:
    """(case_id, kml): the path as one line string, longitude first."""
    at = F.concat_ws(",", *[F.col(c).cast("string") for c in ("longitude", "latitude", "altitude_m")])
    head, tail = _kml_ends(title)
    return _track(telemetry, at).select("case_id", F.concat(F.lit(head + "\n"), F.array_join("rows", "\n"), F.lit("\n" + tail)).alias("kml"))


def _kml_ends(title: str) -> tuple[str, str]:
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{title}</name><Placemark><name>3D Flight Path</name><LineString><extrude>1</extrude><tessellate>1</tessellate><altitudeMode>relativeToGround</altitudeMode><coordinates>'
    return head, "</coordinates></LineString></Placemark></Document></kml>"


def _write_files(points: DataFrame, heads: DataFrame, tails: DataFrame, path: str) -> None:
    """One file per case below path/case_id=...: its head, a line per point in list order, its tail.

    A file is written by one task from sorted rows, which spill; no row holds a track.
    """
    parts = [df.select("case_id", F.lit(i).alias("part"), "ingest_seq", "seq", "value") for i, df in enumerate((heads, points, tails))]
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition("case_id")
    lines.sortWithinPartitions("case_id", "part", "ingest_seq", "seq").select("case_id", "value").write.partitionBy("case_id").text(path)


def _end(cases: DataFrame, value: Column) -> DataFrame:
    return cases.select("case_id", F.lit(0).cast("long").alias("ingest_seq"), F.lit(0).cast("long").alias("seq"), value.alias("value"))


def write_kml(telemetry: DataFrame, path: str, title: str = "UAV Flight") -> None:
    """The text of to_kml as a file per case, for tracks of any length."""
    at = F.concat_ws(",", *[F.col(c).cast("string") for c in ("longitude", "latitude", "altitude_m")])
    cases, (head, tail) = telemetry.select("case_id").distinct(), _kml_ends(title)
    _write_files(telemetry.withColumn("value", at), _end(cases, F.lit(head)), _end(cases, F.lit(tail)), path)


def write_geojson(telemetry: DataFrame, path: str) -> None:
    """The object of to_geojson as a file per case, a line per point, for tracks of any length."""
    at = F.to_json(F.struct(F.array("longitude", "latitude", "altitude_m").alias("x")))
    at = F.regexp_extract(at, r"^\{.x.:(.*)\}$", 1)
    placed = with_place(telemetry)
    points = placed.withColumn("value", F.concat(F.when(F.col("place") > 0, ",").otherwise(""), at))
    ends = placed.groupBy("case_id").agg(
        F.count("*").alias("n"), *[f(F.struct(at.alias("at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts")), "place").alias(name) for name, f in (("first", F.min_by), ("last", F.max_by))]
    )
    point = lambda end, name: F.concat(F.lit(',{"type":"Feature","geometry":{"type":"Point","coordinates":'), F.col(f"{end}.at"), F.lit(f'}},"properties":{{"name":"{name}","timestamp":"'), F.col(f"{end}.ts"), F.lit('"}}'))
    tail = F.concat(F.lit(']},"properties":{"name":"UAV Flight Trajectory","points_count":'), F.col("n").cast("string"), F.lit("}}"), point("first", "Takeoff / Origin"), point("last", "Final Position / Landing"), F.lit("]}"))
    head = F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[')
    _write_files(points, _end(ends, head), _end(ends, tail), path)


def _clock(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def to_srt(slots: DataFrame, step_ms: int = 1000) -> DataFrame:
    """(case_id, slot, srt): a subtitle block per resampled slot."""
    start = F.col("slot") * step_ms
    block = F.concat(
        (F.col("slot") + 1).cast("string"), F.lit("\n"), _clock(start), F.lit(" --> "), _clock(start + step_ms), F.lit("\n"),
        F.lit("[latitude: "), fixed(F.col("latitude"), 7), F.lit("] [longitude: "), fixed(F.col("longitude"), 7), F.lit("] [altitude: "), fixed(F.col("altitude_m"), 2), F.lit("]\n"),
    )
    return slots.select("case_id", "slot", block.alias("srt"))


#: What a subtitle's line shows, its digits and unit.
SHOWN = (("latitude", 7, ""), ("longitude", 7, ""), ("altitude_m", 2, "m"), ("roll_deg", 1, ""), ("pitch_deg", 1, ""), ("yaw_deg", 1, ""))


def emissions_to_srt(emitted: DataFrame, step_ms: int = 1000) -> DataFrame:
    """(case_id, number, srt): a subtitle block with position and attitude per emission (asof.emissions); what isn't known yet is 0."""
    shown = [F.concat(F.lit(f"[{name.split('_')[0]}: "), fixed(F.coalesce(F.col(name), F.lit(0.0)), digits), F.lit(f"{unit}]")) for name, digits, unit in SHOWN]
    block = F.concat(F.col("number").cast("string"), F.lit("\n"), _clock(F.col("clock_ms")), F.lit(" --> "), _clock(F.col("clock_ms") + step_ms), F.lit("\n"), F.concat_ws(" ", *shown), F.lit("\n"))
    return emitted.select("case_id", "number", block.alias("srt"))


def to_dfxml(evidence: DataFrame) -> DataFrame:
    """(case_id, item_id, xml): a fileobject element per evidence item."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(
        F.lit("<fileobject><filename>"), safe("path"), F.lit("</filename><filesize>"), F.col("byte_count").cast("string"), F.lit("</filesize><hashdigest type='md5'>"), "md5", F.lit("</hashdigest><hashdigest type='sha256'>"), "sha256", F.lit("</hashdigest></fileobject>")
    )
    return evidence.select("case_id", "item_id", xml.alias("xml"))


def case_json(summary: DataFrame, **parts: DataFrame) -> DataFrame:
    """(case_id, json): the summary's columns, and each part's rows of the case as an array."""
    found = summary.select("case_id", F.struct(*[c for c in summary.columns if c != "case_id"]).alias("summary"))
    for name, part in parts.items():
        row = F.struct(*[c for c in part.columns if c != "case_id"])
        found = found.join(part.groupBy("case_id").agg(F.array_sort(F.collect_list(row)).alias(name)), "case_id", "left")
    return found.select("case_id", F.to_json(F.struct(F.col("case_id"), "summary", *parts)).alias("json"))


def write_by_category(table: DataFrame, path: str) -> None:
    """A table in one folder per case and category; the folders written replace those there."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id", "category").parquet(path)


def delete_cases(table: DataFrame, cases: DataFrame) -> DataFrame:
    """table without the rows of these cases."""
    return table.join(cases.select("case_id"), "case_id", "left_anti")
