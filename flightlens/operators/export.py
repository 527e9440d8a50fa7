"""A case's whole export as one JSON document a case, of any size.

The document is written as sorted lines: a line for each object and for each row of an array, so
no row and no task's memory holds a case. A row's comma depends on whether it is its array's
first, which one aggregate with a row per case and array tells.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightlens.session import forget, spent_shuffles, stored

#: Evidence categories and their names in an export.
CATEGORIES = {"logs": "LOGS", "video_images": "VIDEO_IMAGES", "gcs": "GCS"}
ORDER = ("o1", "o2", "o3")
#: Lines that one task writes.
LINES_A_FILE = 200_000


def _line(cases: DataFrame, part: int, text: Column) -> DataFrame:
    return cases.select("case_id", F.lit(part).alias("part"), *[F.lit(0).cast("long").alias(o) for o in ORDER], text.alias("value"))


def _object(cases: DataFrame, part: int, name: str, rows: DataFrame | None, key: Column, end: str) -> DataFrame:
    """The line of an object that rows give once a case; null where they don't."""
    if rows is None:
        return _line(cases, part, F.concat(key, F.lit(f"null{end}")))
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "case_id"]), {"ignoreNullFields": "false"})
    found = cases.join(rows.select(F.col("case_id").alias("_case"), body.alias("_body")), F.col("case_id").eqNullSafe(F.col("_case")), "left")
    return _line(found, part, F.concat(key, F.coalesce("_body", F.lit("null")), F.lit(end)))


def _array(cases: DataFrame, part: int, rows: DataFrame, order: list[str], key: Column, end: str, spent: list[DataFrame]) -> DataFrame:
    """The lines of an array: its head, a line for each row in the order of up to three whole numbers, its end.

    The rows are stored, as they are read several times, and so is each case's first place: a small
    table of known size is broadcast, so that marking the first row needs no shuffle of all.
    """
    given = [F.col(c).cast("long") for c in order] + [F.lit(0).cast("long")] * (len(ORDER) - len(order))
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "case_id" and not c.startswith("_")]), {"ignoreNullFields": "false"})
    lines = stored(rows.join(cases, "case_id", "left_semi").select("case_id", *[c.alias(o) for c, o in zip(given, ORDER, strict=True)], body.alias("value")), "zstd")
    first = stored(lines.groupBy("case_id").agg(F.min(F.struct(*ORDER)).alias("_first")).withColumnRenamed("case_id", "_case"))
    spent += [lines, first]
    comma = F.when(F.struct(*ORDER) == F.col("_first"), " ").otherwise(",")
    marked = lines.join(first, F.col("case_id") == F.col("_case")).withColumn("value", F.concat(comma, "value"))
    inside = marked.select("case_id", F.lit(part + 1).alias("part"), *ORDER, "value")
    return _line(cases, part, F.concat(key, F.lit("["))).unionByName(inside).unionByName(_line(cases, part + 2, F.lit(f"]{end}")))


def write_case_json(
    cases: DataFrame,
    objects: dict[str, DataFrame | None],
    arrays: dict[str, tuple[DataFrame, list[str]]],
    evidence: tuple[DataFrame, list[str]],
    counts: DataFrame,
    generated_at: str,
    path: str,
    compression: str | None = None,
) -> None:
    """Every case's document below path/case_id=..., as files that follow each other by their names, of LINES_A_FILE each.

    compression: a codec of Spark's text files, such as gzip, whose files follow each other as well.

    cases: one row a case, with what its `case` object shows. objects: flight_summary,
    ground_control_station, gcs_analysis and mobile_companion_analysis, one row a case each, or
    None. arrays: rows, and the whole numbers that order them without ties, of
    geofence_violations, anomalies, timeline, chain_of_custody, wireless_sessions and media_items.
    evidence: rows with category, and their order. counts: one row a case with evidence_counts.
    """
    ids = stored(cases.select("case_id"))
    key = lambda name: F.lit(f'"{name}": ')
    rows, order = evidence
    plan = [("object", "case", cases.select("*", F.col("case_id").alias("case"))), ("object", "flight_summary", objects.get("flight_summary")), ("array", "evidence_items", evidence), ("object", "evidence_counts", counts), ("open", "evidence_by_category", None)]
    plan += [("array", name, (rows.filter(F.col("category") == category), order)) for name, category in CATEGORIES.items()]
    plan += [("close", "", None)]
    plan += [("array", name, arrays[name]) for name in ("geofence_violations", "anomalies", "timeline", "chain_of_custody")]
    plan += [("object", name, objects.get(name)) for name in ("ground_control_station", "gcs_analysis", "mobile_companion_analysis")]
    plan += [("array", name, arrays[name]) for name in ("wireless_sessions", "media_items")]
    spent = [ids]
    found = [_line(ids, 0, F.lit("{"))]
    for i, (kind, name, held) in enumerate(plan):
        part, end = 10 * (i + 1), "," if i + 1 == len(plan) or plan[i + 1][0] != "close" else ""
        if kind == "object":
            found.append(_object(ids, part, name, held, key(name), end))
        elif kind == "array":
            found.append(_array(ids, part, *held, key(name), end, spent))
        else:
            found.append(_line(ids, part, F.concat(key(name), F.lit("{")) if kind == "open" else F.lit("},")))
    found.append(_line(ids, 10 * (len(plan) + 1), F.lit(f'"generated_at_utc": "{generated_at}"}}')))
    write_lines(reduce(DataFrame.unionByName, found), path, compression)
    forget(*spent)


def write_report(summary: DataFrame, arrays: dict[str, tuple[DataFrame, list[str]]], path: str, compression: str | None = None) -> None:
    """sinks.case_json as documents of any size below path/case_id=...: the summary's columns, and each array's rows in the order of up to three whole numbers."""
    ids = stored(summary.select("case_id"))
    spent = [ids]
    key = lambda name: F.lit(f'"{name}": ')
    found = [_line(ids, 0, F.concat(F.lit('{"case_id": '), F.to_json(F.struct("case_id")).substr(F.lit(12), F.length(F.to_json(F.struct("case_id"))) - 12), F.lit(","))), _object(ids, 1, "summary", summary, key("summary"), "," if arrays else "")]
    for i, (name, (rows, order)) in enumerate(arrays.items()):
        found.append(_array(ids, 10 * (i + 1), rows, order, key(name), "," if i + 1 < len(arrays) else "", spent))
    write_lines(reduce(DataFrame.unionByName, [*found, _line(ids, 10 * (len(arrays) + 1), F.lit("}"))]), path, compression)
    forget(*spent)


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> None:
    """Lines in order as files of about LINES_A_FILE: a document is its case's files, one after the other by their names."""
    with spent_shuffles(lines.sparkSession):
        ordered = lines.repartitionByRange(1 + lines.count() // LINES_A_FILE, "case_id", "part", *ORDER).sortWithinPartitions("case_id", "part", *ORDER)
        ordered.select("case_id", "value").write.partitionBy("case_id").option("compression", compression or "none").text(path)


def read_rows(spark: SparkSession, path: str, kept: Callable[[Column], Column] = lambda row: row) -> DataFrame:
    """(case_id, array, number, block, id, value) of the rows of all arrays of documents as they are written here, by lines.

    (number, block, id) is the order of a case's lines. A row belongs to the array whose head,
    of which a case has a few, is the last before it. value is what `kept` makes of a row's text;
    lines are stored with that alone.
    """
    written = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    read = written.select(F.regexp_extract("file", r"case_id=(-?\d+)", 1).cast("long").alias("case_id"), F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("number"), "block", "id", "value")
    head = F.when(F.col("value").startswith('"'), F.regexp_extract("value", r'^"(\w+)": \[$', 1)).otherwise("")
    rows = read.filter(F.substring("value", 1, 2).isin(" {", ",{") | (head != ""))
    lines = stored(rows.select("case_id", "number", "block", "id", head.alias("head"), F.when(head == "", kept(F.substring("value", 2, 1 << 30))).alias("value")))
    place = F.struct("number", "block", "id")
    begun = lines.filter("head <> ''").select(F.col("case_id").alias("_case"), F.col("head").alias("array"), place.alias("_from"))
    heads = stored(begun.withColumn("_to", F.lead("_from").over(Window.partitionBy("_case").orderBy("_from"))))
    inside = (place > F.col("_from")) & (F.col("_to").isNull() | (place < F.col("_to")))
    return lines.filter("head = ''").join(heads, (F.col("case_id") == F.col("_case")) & inside).select("case_id", "array", "number", "block", "id", "value")
