"""Jobs: the operators chained over a case's tables, from files to index and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.operators import anomalies, asof, custody, evidence, export, geofence, mission, retrieval, sinks, summary, timeline
from flightlens.sources import binary
from flightlens.sources.lines import parse_ts


def manifest(spark: SparkSession, path: str, case_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(manifest, totals) of every file below path: hashes, category and platform; files and bytes."""
    files = binary.read_files(spark, path).withColumn("head", evidence.head_text(F.col("content")))
    hashed = evidence.hash_manifest(files, F.col("content"))
    items = hashed.select(
        F.lit(case_id).cast("long").alias("case_id"), F.sha2("path", 256).alias("item_id"), "path", "byte_count", "sha256", "md5", "sha3_256",
        evidence.classify(F.col("path"), F.col("head")).alias("category"), evidence.detect_platform(F.col("path"), F.col("head")).alias("platform"),
    )
    return items, evidence.acquisition_totals(items)


def media_timestamp(media: DataFrame) -> DataFrame:
    """media with ts and timestamp_source: the container's time, else a tag's, the client's, the file's."""
    order: dict[str, Column] = {
        "CONTAINER": F.col("container_ts"), "TAG": parse_ts(F.col("tag_date")), "CLIENT": parse_ts(F.col("client_ts")), "FILE": F.col("modified_ts"),
    }
    source = reduce(lambda w, kv: w.when(kv[1].isNotNull(), kv[0]), list(order.items())[1:], F.when(F.col("container_ts").isNotNull(), "CONTAINER"))
    return media.withColumns({"ts": F.coalesce(*order.values()), "timestamp_source": source})


def file_metadata(telemetry: DataFrame, events: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Per file: rows, events, and planned distance where a plan came with it."""
    points = telemetry.groupBy("file").agg(F.count("*").alias("points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max("altitude_m").alias("max_altitude_m"))
    found = points.join(events.groupBy("file").agg(F.count("*").alias("events")), "file", "full_outer")
    if plans is not None:
        legs = mission.plan_metrics(plans.withColumns({"case_id": F.col("file"), "plan_id": F.col("file")})).select(F.col("case_id").alias("file"), "waypoints", "planned_distance_m")
        found = found.join(legs, "file", "full_outer")
    return found.withColumns({"points": F.coalesce("points", F.lit(0)), "events": F.coalesce("events", F.lit(0))})


def analyze(telemetry: DataFrame, events: DataFrame, zones: DataFrame) -> dict[str, DataFrame]:
    """Breaches, episodes, anomalies, summary and timeline of the cases in telemetry."""
    breaches = geofence.geofence_violations(telemetry, zones)
    found = anomalies.anomaly_report(telemetry, events)
    return {
        "violations": breaches,
        "episodes": geofence.breach_episodes(telemetry, zones),
        "anomalies": found,
        "summary": summary.flight_summary(telemetry, events),
        "timeline": timeline.master_timeline(events, breaches, found),
    }


def ingest_case(chunks: list[DataFrame], path: str) -> None:
    """Chunks of several sources, embedded and written as the index, a partition per case; a repeated ingest replaces."""
    known = retrieval.all_chunks(*chunks).sortWithinPartitions("case_id")  # before the vectors, so that the write needn't sort them
    retrieval.write_index(retrieval.hash_embed(known), path)


def retrieve(spark: SparkSession, path: str, questions: DataFrame, k: int = retrieval.QUERY_K, where: Column | None = None) -> DataFrame:
    """Per question (query_id, case_id, text): its k nearest chunks as one numbered text; stops before any text is generated."""
    index = spark.read.parquet(path)
    asked = retrieval.hash_embed(questions).select("query_id", "case_id", F.col("embedding").alias("query_vector"))
    return retrieval.numbered_sources(retrieval.top_k(asked, index, k, where), index)


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a vault by name; reading a case prunes to its partition."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as partitions per case; the cases written replace those there."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(f"{path}/{name}")


def case_report(analysis: dict[str, DataFrame], plans: DataFrame | None = None, apps: DataFrame | None = None, custody_log: DataFrame | None = None, key: bytes | None = None) -> DataFrame:
    """(case_id, json): summary, breaches, anomalies, episodes, and plans, apps and custody state where given."""
    parts = {n: analysis[n].drop("ingest_seq") for n in ("violations", "anomalies", "episodes")}
    if plans is not None:
        parts["plans"] = mission.plan_metrics(plans)
    if apps is not None:
        parts["apps"] = apps
    if custody_log is not None and key is not None:
        parts["custody"] = custody.chain_verify(custody_log, key)
    return sinks.case_json(analysis["summary"], **parts)


def write_case_report(analysis: dict[str, DataFrame], path: str, plans: DataFrame | None = None, compression: str | None = None) -> None:
    """case_report as documents below path/case_id=..., for cases of any size; rows by their numbers and places."""
    number = lambda c, at: F.substring(c, at, 20).cast("long")
    arrays = {
        "violations": (analysis["violations"].drop("ingest_seq").withColumn("_o", number("violation_id", 5)), ["_o"]),
        "anomalies": (analysis["anomalies"].drop("ingest_seq").withColumn("_o", number("anomaly_id", 6)), ["_o"]),
        "episodes": (analysis["episodes"].withColumn("_o", F.xxhash64("zone_id")), ["first_place", "_o"]),
    }
    if plans is not None:
        arrays["plans"] = (mission.plan_metrics(plans).withColumn("_o", F.xxhash64("plan_id")), ["_o"])
    export.write_report(analysis["summary"], arrays, path, compression)


def match_media(media: DataFrame, telemetry: DataFrame) -> dict[str, DataFrame]:
    """Overlaps, captures and events of media rows (media_id, case_id, ts, duration_sec, tag_*)."""
    overlap = asof.media_overlap(media, telemetry)
    return {"overlap": overlap, "captures": asof.media_capture(media, overlap), "events": asof.media_events(overlap)}
