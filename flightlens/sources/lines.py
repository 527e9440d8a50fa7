"""Directories of text files as rows of lines, and columns found by header names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A number at most once per parser: without it the line gives no value.
NUMBER = r"([+-]?\d+(?:\.\d+)?)"
PLACE = ("block", "id")


def read_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(file, block, id, line): files are split across tasks; (block, id) is the order within a file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    return rows.select("file", "block", F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"^﻿|\r$", "").alias("line"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row per file, for formats that only parse as a whole, such as JSON plans."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def numbered(rows: DataFrame, start: int = 0, name: str = "seq") -> DataFrame:
    """Rows with their place in their file, counted after whatever filters came before."""
    order = Window.partitionBy("file").orderBy(*PLACE)
    return rows.withColumn(name, (F.row_number().over(order) - 1 + start).cast("long"))


def fields(line: Column, sep: str = ",") -> Column:
    return F.transform(F.split(line, sep, -1), lambda x: F.trim(x))


def number(value: Column) -> Column:
    """A double, or null where the text is none."""
    return value.try_cast("double")


def at(parts: Column, index: Column | int) -> Column:
    """The element at a 0-based index; null outside, and for a null index."""
    index = F.lit(index) if isinstance(index, int) else index
    return F.when(index.isNotNull() & (index >= 0), F.get(parts, index.cast("int")))


def find_column(header: Column, *patterns: str) -> Column:
    """0-based index of the first header that holds the first pattern any header holds; null if none does."""
    return F.coalesce(*[_position(header, p) for p in patterns]) - 1


def _position(header: Column, pattern: str) -> Column:
    found = F.array_position(F.transform(header, lambda h: h.contains(pattern)), F.lit(True))
    return F.when(found > 0, found)


def named_column(header: Column, *names: str) -> Column:
    """0-based index of the first of these names that is a header; null if none is."""
    return F.coalesce(*[F.when(F.array_position(header, n) > 0, F.array_position(header, n)) for n in names]) - 1


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, header, parts) of the data lines of separated files.

    The first filled line of a file is its header, behind an optional 'sep=' line. Its place
    is found from numbers alone, so no lines are sorted; the headers, one row per file, are
    joined back to the lines.
    """
    lines = read_lines(spark, path).filter((F.trim("line") != "") & ~F.lower("line").startswith("sep="))
    firsts = lines.groupBy("file", "block").agg(F.min("id").alias("id")).groupBy("file").agg(F.min(F.struct("block", "id")).alias("h"))
    heads = lines.join(F.broadcast(firsts), "file").filter((F.col("block") == F.col("h.block")) & (F.col("id") == F.col("h.id")))
    heads = heads.select("file", F.col("block").alias("hb"), F.col("id").alias("hi"), fields(F.lower("line")).alias("header"))
    body = lines.join(heads, "file").filter((F.col("block") != F.col("hb")) | (F.col("id") != F.col("hi")))
    return body.select("file", "block", "id", "header", fields(F.col("line")).alias("parts"))


def parse_ts(raw: Column) -> Column:
    """ISO times with Z or an offset, then plain and camera formats; without a zone UTC; null if none fits."""
    text = F.regexp_replace(F.trim(raw), "Z$", "+00:00")
    formats = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy:MM:dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
    return F.coalesce(text.try_cast("timestamp"), *[F.try_to_timestamp(F.trim(raw), F.lit(f)) for f in formats])


def clock(base: str, seconds: Column) -> Column:
    """A time so many seconds after a given one, for files that carry none."""
    return F.timestamp_micros(F.unix_micros(F.lit(base).cast("timestamp")) + (seconds * 1_000_000).cast("long"))
