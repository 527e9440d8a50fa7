"""Retrieval over case records: chunk texts, hashed embeddings, an index table and top-k."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flightlens.functions.geo import fixed

DIMS = 768
QUERY_K, STORE_K = 10, 8
# The sentences of the chunk_* texts, with their labels, are fixed values.
#: Queries that are broadcast at once: 8 bytes a dimension, so tens of MB.
QUERY_BLOCK = 4_096
#: Texts are embedded in slices of about so many texts or characters.
SLICE_TEXTS, SLICE_CHARS = 1_000, 250_000
#: Words whose places a worker remembers, and scores that a slice of chunks has with the queries.
MOST_WORDS, SLICE_SCORES = 100_000, 2_000_000
_SEPARATORS = ",|:"


def _stamp(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("N/A"))


def _place(prefix: str = "") -> Column:
    lat, lon, alt = (F.col(prefix + c) for c in ("latitude", "longitude", "altitude_m"))
    text = F.concat(F.lit("lat="), fixed(lat, 6), F.lit(", lon="), fixed(lon, 6), F.lit(", alt="), fixed(alt, 1), F.lit("m"))
    return F.when(lat.isNotNull() & lon.isNotNull(), text).otherwise("coordinates=N/A")


def _time(rows: DataFrame, name: str) -> Column:
    """A time as metadata: the stamp, empty for nulls and where rows have none."""
    return F.when(F.col(name).isNotNull(), _stamp(F.col(name))) if name in rows.columns else F.lit(None).cast("string")


def _some(rows: DataFrame, *names: str) -> dict[str, Column]:
    """Metadata of those columns that rows have."""
    return {n: F.col(n) for n in names if n in rows.columns}


def _chunks(rows: DataFrame, kind: str, text: Column, place: Column, **metadata: Column) -> DataFrame:
    tags = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]).cast("map<string,string>")
    return rows.select("case_id", F.lit(kind).alias("chunk_type"), place.alias("place"), text.alias("text"), tags.alias("metadata"))


def chunk_events(events: DataFrame) -> DataFrame:
    """One text per flight event."""
    text = F.concat(
        F.lit("[FLIGHT_EVENT] Type: "), "event_type", F.lit(" | Severity: "), "severity", F.lit(" | Time (UTC): "), _stamp(F.col("ts")), F.lit(" | Location: "), _place(), F.lit(" | Description: "), "description"
    )
    return _chunks(events, "flight_event", text, F.col("seq").cast("long"), event_type=F.col("event_type"), severity=F.col("severity"))


def chunk_violations(violations: DataFrame) -> DataFrame:
    """One text per geofence breach."""
    text = F.concat(
        F.lit("[GEOFENCE_VIOLATION] Zone: '"), "zone_name", F.lit("' (ID: "), "zone_id", F.lit(") | Breach Type: "), "violation_type", F.lit(" | Severity: "), "severity",
        F.lit(" | Timestamp (UTC): "), _stamp(F.col("ts")), F.lit(" | Breach Coordinates: "), _place(), F.lit(" | Jurisdiction Authority: "), F.coalesce("authority", F.lit("DGCA / Local Civil Aviation")),
        F.lit(" | Airspace Category: "), F.coalesce("category", F.lit("RESTRICTED")), F.lit(" | Details: "), "details",
    )
    return _chunks(violations, "geofence_violation", text, F.col("seq") * 1000 + F.col("zone_pos"), **_some(violations, "zone_id", "zone_name", "violation_type", "severity", "latitude", "longitude", "altitude_m"), timestamp_utc=_time(violations, "ts"))


#: Metrics of an anomaly that its text names.
MOST_METRICS = 6


def chunk_anomalies(anomalies: DataFrame) -> DataFrame:
    """One text per anomaly; evidence_ref and metrics (an array of name, value) where given, of these the first MOST_METRICS."""
    metrics = F.lit("")
    if "metrics" in anomalies.columns:
        shown = F.transform(F.slice("metrics", 1, MOST_METRICS), lambda m: F.concat(m["name"], F.lit("="), m["value"]))
        metrics = F.when(F.size("metrics") > 0, F.concat(F.lit(" | Forensic Metrics: "), F.array_join(shown, ", "))).otherwise("")
    text = F.concat(
        F.lit("[ANOMALY_DETECTION] Type: "), "anomaly_type", F.lit(" | Severity: "), "severity", F.lit(" | Timestamp (UTC): "), _stamp(F.col("ts")),
        F.lit(" | Evidence Reference: "), _own(anomalies, "evidence_ref", "Flight Log"), F.lit(" | Description: "), "description", metrics,
    )
    return _chunks(anomalies, "anomaly_report", text, F.col("seq").cast("long"), **_some(anomalies, "anomaly_type", "severity"), timestamp_utc=_time(anomalies, "ts"), evidence_ref=_own(anomalies, "evidence_ref", ""))


def chunk_windows(windows: DataFrame) -> DataFrame:
    """One text per window of telemetry rows; start and end places and the source where given (telemetry_windows with ends)."""
    battery = F.when(F.col("min_battery_pct").isNull(), "Batt: N/A").otherwise(F.concat(F.lit("Batt: "), fixed(F.col("min_battery_pct"), 1), F.lit("% - "), fixed(F.col("max_battery_pct"), 1), F.lit("%")))
    places = F.concat(F.lit(" | Start Location: "), _place("start_"), F.lit(" | End Location: "), _place("end_")) if "start_latitude" in windows.columns else F.lit("")
    text = F.concat(
        F.lit("[TELEMETRY_WINDOW] Time: "), _stamp(F.col("start_ts")), F.lit(" to "), _stamp(F.col("end_ts")), F.format_string(" (%d samples)", "samples"), places,
        F.lit(" | Altitude Range: "), fixed(F.col("min_altitude_m"), 1), F.lit("m to "), fixed(F.col("max_altitude_m"), 1), F.lit("m | Max Speed: "), fixed(F.col("max_speed_mps"), 1),
        F.lit(" m/s (avg "), fixed(F.col("avg_speed_mps"), 1), F.lit(" m/s) | "), battery, _labelled(windows, ("Source", "source_channel", "")),
    )
    return _chunks(
        windows, "telemetry_window", text, F.col("win").cast("long"), samples_count=F.col("samples"), start_time_utc=_time(windows, "start_ts"), end_time_utc=_time(windows, "end_ts"), **_some(windows, "min_altitude_m", "max_altitude_m", "max_speed_mps")
    )


def chunk_custody(custody: DataFrame) -> DataFrame:
    """One text per custody entry; its time (ts, or ts_raw as it is written) and evidence item where given."""
    rows = custody.withColumn("timestamp_utc", _stamp(F.col("ts"))) if "ts" in custody.columns else custody.withColumnRenamed("ts_raw", "timestamp_utc")
    text = F.concat(
        F.lit("[CHAIN_OF_CUSTODY] Sequence #"), F.col("entry_id").cast("string"), F.lit(" | Actor: "), "actor", F.lit(" | Action: "), "action", _labelled(rows, ("Timestamp (UTC)", "timestamp_utc", "N/A")), F.lit(" | Details: "), "details",
        _labelled(rows, ("Evidence Item", "evidence_item_id", "Case Vault")), F.lit(" | HMAC Signature: "), F.substring("signature", 1, 16), F.lit("..."),
    )
    return _chunks(rows, "custody", text, F.col("entry_id").cast("long"), **_some(rows, "entry_id", "actor", "action", "timestamp_utc", "signature"))


def chunk_evidence(items: DataFrame) -> DataFrame:
    """One text per evidence file."""
    text = F.concat(
        F.lit("[EVIDENCE_ITEM] File: "), "path", F.lit(" (Item ID: "), "item_id", F.lit(") | Platform: "), F.coalesce("platform", F.lit("UNKNOWN")), F.lit(" | Category: "), "category",
        F.lit(" | Size: "), F.col("byte_count").cast("string"), F.lit(" bytes | SHA-256: "), "sha256",
    )
    return _chunks(items, "evidence_item", text, F.abs(F.xxhash64("item_id")), item_id=F.col("item_id"), category=F.col("category"))


def chunk_media(captures: DataFrame) -> DataFrame:
    """One text per media file, with its matched place if it has one."""
    place = F.when(F.col("latitude").isNotNull(), _place()).otherwise("spatial match=PENDING")
    text = F.concat(
        F.lit("[MEDIA_RECORD] Type: "), "media_type", F.lit(" | File: "), "file_name", F.lit(" | Capture Timestamp: "), F.coalesce(F.when(F.col("ts").isNotNull(), _stamp(F.col("ts"))), F.lit("UNKNOWN")),
        F.lit(" | Telemetry Overlap: "), F.initcap(F.col("has_overlap").cast("string")), F.lit(" | Geo-Coordinates: "), place,
    )
    return _chunks(captures, "media_record", text, F.col("media_id").cast("long"), media_type=F.col("media_type"))


def _own(rows: DataFrame, name: str, default: str) -> Column:
    """A column as text where rows have it, else, and for nulls, what stands for it."""
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in rows.columns else F.lit(default)


def _labelled(rows: DataFrame, *parts: tuple[str, str, str]) -> Column:
    """' | Label: value' of those (label, column, default) whose column rows have."""
    return F.concat(F.lit(""), *[F.concat(F.lit(f" | {label}: "), _own(rows, name, default)) for label, name, default in parts if name in rows.columns])


def _metres(rows: DataFrame, name: str) -> DataFrame:
    """rows with a length as text of one decimal, 0.0 for nulls, if they have it."""
    return rows.withColumn(name, fixed(F.coalesce(name, F.lit(0.0)), 1)) if name in rows.columns else rows


def _pairs(column: str) -> Column:
    """'key=value' of a map's filled values, joined."""
    filled = F.filter(F.map_entries(column), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(filled, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def chunk_plans(plans: DataFrame) -> DataFrame:
    """One text per mission plan (plan_id, gcs_name, waypoints, planned_distance_m, planned_max_altitude_m; file_name and geofence_included where given)."""
    text = F.concat(
        F.lit("[MISSION_PLAN] Plan ID: "), "plan_id", F.lit(" | Target GCS: "), "gcs_name", _labelled(plans, ("File", "file_name", "")), F.lit(" | Waypoints Count: "), F.col("waypoints").cast("string"),
        F.lit(" | Total Planned Distance: "), fixed(F.col("planned_distance_m"), 1), F.lit("m | Max Altitude: "), fixed(F.col("planned_max_altitude_m"), 1), F.lit("m"),
        F.concat(F.lit(" | Geofence Included: "), F.initcap(F.col("geofence_included").cast("string"))) if "geofence_included" in plans.columns else F.lit(""),
    )
    return _chunks(plans, "mission_plan", text, F.abs(F.xxhash64("plan_id")), plan_id=F.col("plan_id"), gcs_name=F.col("gcs_name"))


def chunk_operators(fixes: DataFrame, mobile: bool = False) -> DataFrame:
    """One text per operator position, of a ground station (with its altitude, where given) or of a phone; time, accuracy and description where given."""
    head = "[MOBILE_OPERATOR_FIX] Source: " if mobile else "[OPERATOR_LOCATION] Source: "
    fixes = _metres(_metres(fixes, "accuracy_m"), "altitude_m")
    stamped = fixes.withColumn("ts", _stamp(F.col("ts"))) if "ts" in fixes.columns else fixes
    altitude = F.concat(F.lit(", alt="), F.col("altitude_m"), F.lit("m")) if "altitude_m" in fixes.columns and not mobile else F.lit("")
    accuracy = F.concat(F.lit(" | Accuracy: "), F.col("accuracy_m"), F.lit("m")) if "accuracy_m" in fixes.columns else F.lit("")
    text = F.concat(
        F.lit(head), "source", F.lit(" | Coordinates: lat="), fixed(F.col("latitude"), 6), F.lit(", lon="), fixed(F.col("longitude"), 6), altitude,
        _labelled(stamped, ("Timestamp (UTC)", "ts", "N/A")), accuracy, _labelled(stamped, ("Description", "description", "")),
    )
    return _chunks(stamped, "mobile_operator_fix" if mobile else "operator_location", text, F.col("pos").cast("long"), source=F.col("source"), latitude=F.col("latitude"), longitude=F.col("longitude"))


def chunk_stations(overviews: DataFrame) -> DataFrame:
    """One text per case's ground-station overview (plans, commands; station, controller and artifacts where given)."""
    named = _labelled(overviews, ("Ground Control Station", "station", "N/A"), ("Flight Controller", "controller", "N/A"))
    files = F.concat(F.lit(" | Artifacts Found: "), F.col("artifacts").cast("string"), F.lit(" files")) if "artifacts" in overviews.columns else F.lit("")
    rest = F.concat(named, files, F.lit(" | Mission Plans: "), F.col("plans").cast("string"), F.lit(" | Commands Issued: "), F.size("commands").cast("string"))
    return _chunks(overviews, "gcs_overview", F.concat(F.lit("[GCS_ANALYSIS] "), F.substr(rest, F.lit(4))), F.lit(0).cast("long"), plans=F.col("plans"), detected_gcs=_own(overviews, "station", ""))


def chunk_apps(artifacts: DataFrame) -> DataFrame:
    """One text per companion app of a case, with its hardware and logs; package_id and the map pilot_account where given."""
    hardware = _pairs("hardware")
    package = F.concat(F.lit(" ("), _own(artifacts, "package_id", "unknown package"), F.lit(")")) if "package_id" in artifacts.columns else F.lit("")
    pilot = F.lit("")
    if "pilot_account" in artifacts.columns:
        account = F.coalesce(_pairs("pilot_account"), F.lit(""))
        pilot = F.concat(F.lit(" | Pilot Account: "), F.when(account == "", "Unregistered/Anonymous").otherwise(account))
    text = F.concat(
        F.lit("[MOBILE_APP_ARTIFACT] App: "), "app_name", package, F.lit(" | Platform: "), "platform", pilot, F.lit(" | Paired Hardware: "), F.when(hardware == "", "None").otherwise(hardware), F.lit(" | Flight Logs Cached: "), F.size("logs").cast("string")
    )
    return _chunks(artifacts, "mobile_artifact", text, F.abs(F.xxhash64("app_name")), app_name=F.col("app_name"), target_platform=F.col("platform"))


def chunk_app_overview(overviews: DataFrame) -> DataFrame:
    """One text per case's companion apps; waypoints and operator fixes where given."""
    named = lambda c, none: F.when(F.size(c) == 0, none).otherwise(F.array_join(c, ", "))
    text = F.concat(
        F.lit("[MOBILE_COMPANION] Companion Apps Detected: "), named("apps", "None"), F.lit(" | Platforms: "), named("platforms", "N/A"), F.lit(" | Total Flight Records: "), F.col("points").cast("string"),
        _labelled(overviews, ("Waypoints Recovered", "waypoints", "0"), ("Operator Fixes", "operator_fixes", "0")),
    )
    return _chunks(overviews, "mobile_overview", text, F.lit(0).cast("long"))


def chunk_regulations(corpus: DataFrame, cases: DataFrame) -> DataFrame:
    """One text per reference rule (id, title, authority, text) and case; the rules are a small table of the caller's."""
    rows = cases.select("case_id").distinct().withColumn("j", F.lit(1)).join(F.broadcast(corpus.withColumn("j", F.lit(1))), "j")
    text = F.concat(F.lit("[REGULATION_STANDARD] "), "title", F.lit(" | Authority: "), "authority", F.lit(" | Provisions: "), "text")
    return _chunks(rows, "regulation", text, F.abs(F.xxhash64("id")), title=F.col("title"))


def all_chunks(*parts: DataFrame) -> DataFrame:
    """The chunks of several sources with ids of case, source and place."""
    return reduce(DataFrame.unionByName, parts).withColumn("chunk_id", F.concat_ws("_", F.col("case_id").cast("string"), "chunk_type", F.col("place").cast("string")))


def _digits(found: hashlib._Hash) -> int:
    return int(found.hexdigest()[:8], 16)


class _Trigrams:
    """Places of character trigrams in the vector, remembered as sorted codes."""

    def __init__(self, dims: int, most: int = 300_000) -> None:
        self.dims, self.most = dims, most
        self.codes, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The place of each of these different codes, three characters of 21 bits each."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        new = codes[~known]
        terms = ["".join(chr(int(c) >> shift & 0x1FFFFF) for shift in (42, 21, 0)).lower() for c in new]
        found = [(_digits(hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False)) >> 4) % self.dims for t in terms]
        places = np.zeros(len(codes), np.int64)
        places[known], places[~known] = self.places[at[known]], found
        if len(self.codes) + len(new) > self.most:
            self.codes, self.places = codes, places
        else:
            codes = np.concatenate([self.codes, new])
            order = np.argsort(codes)
            self.codes, self.places = codes[order], np.concatenate([self.places, np.array(found, np.int64)])[order]
        return places


class _Words(dict):
    """Place and sign of a word, remembered."""

    def __init__(self, dims: int) -> None:
        self.dims = dims

    def __missing__(self, word: str) -> tuple[int, float]:
        code = _digits(hashlib.sha256(word.encode("utf-8", "surrogatepass")))
        self[word] = found = code % self.dims, 1.0 if code >> 16 & 1 == 0 else -1.0
        return found


def _embedded(texts: list[str], dims: int, words: _Words, trigrams: _Trigrams) -> np.ndarray:
    """A row of unit length for each text, or of zeros."""
    split = [re.split(r"\s+", reduce(lambda x, c: x.replace(c, " "), _SEPARATORS, t.lower()).strip()) for t in texts]
    filled = [s != [""] for s in split]
    terms = [words[w] for s, f in zip(split, filled, strict=True) if f for w in s]
    rows = np.repeat(np.arange(len(texts)), [len(s) if f else 0 for s, f in zip(split, filled, strict=True)])
    at, weights = np.array([t[0] for t in terms], np.int64), np.array([t[1] for t in terms])
    total = np.bincount(rows * dims + at, weights, len(texts) * dims)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends, worded = np.cumsum([len(t) for t in texts]), np.array(filled)
    for low in range(0, len(points) - 2, SLICE_CHARS):
        part = points[low : low + SLICE_CHARS + 2].astype(np.int64)
        codes, at = part[:-2] << 42 | part[1:-1] << 21 | part[2:], np.arange(low, low + len(part) - 2)
        owner = np.searchsorted(ends, at, side="right")
        inside = (ends[owner] - at >= 3) & worded[owner]
        different, which = np.unique(codes[inside], return_inverse=True)
        total += 0.5 * np.bincount(owner[inside] * dims + trigrams(different)[which], minlength=len(total))
    vectors = total.reshape(len(texts), dims)
    norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.where(norms > 1e-6, vectors / np.maximum(norms, 1e-6), vectors).astype(np.float32)


def hash_embed(texts: DataFrame, dims: int = DIMS) -> DataFrame:
    """texts with an `embedding` of unit length of hashed words and character trigrams; texts without words have zeros.

    A text has few different trigrams over and over: they are hashed once for a slice of
    texts, remembered in a worker, and added up as counts. Slices and what is remembered are
    bounded, and vectors are handed on as one Arrow array.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, trigrams = _Words(dims), _Trigrams(dims)
        for batch in batches:
            found = [np.zeros((0, dims), np.float32)]
            chars = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(batch), 0)))
            cuts = np.flatnonzero(np.diff(np.maximum(chars // SLICE_CHARS, 0) + np.arange(len(batch)) // SLICE_TEXTS)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                found.append(_embedded([t or "" for t in batch.slice(a, b - a).to_pylist()], dims, words, trigrams))
                if len(words) > MOST_WORDS:
                    words.clear()
            flat = np.concatenate(found).reshape(-1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), pa.array(flat))

    return texts.withColumn("embedding", embed("text"))


def _in_turn(products: np.ndarray) -> np.ndarray:
    """Sums of the rows, added from left to right."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _vectors(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Sizes of vectors, and by size the places and rows of those; vectors that are null or hold a null have size -1."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    flat = column.flatten()
    if flat.null_count:
        holds = np.unique(np.asarray(pc.list_parent_indices(column))[np.asarray(flat.is_null())])
        column = pc.if_else(pa.array(~np.isin(np.arange(len(column)), holds)), column, pa.scalar(None, column.type))
        sizes[holds], flat = -1, column.flatten()
    values, owner = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.repeat(sizes, np.maximum(sizes, 0))
    return sizes, {int(n): (np.flatnonzero(sizes == n), values[owner == n].reshape(-1, n)) for n in np.unique(sizes) if n > 0}


def _lengths(sizes: np.ndarray, by_size: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The vectors' lengths; zero for those of no size."""
    found = np.zeros(len(sizes))
    for at, rows in by_size.values():
        found[at] = np.sqrt(_in_turn(rows * rows))
    return found


@F.arrow_udf(T.DoubleType())
def _length(vectors: pa.Array) -> pa.Array:
    found = []
    for low in range(0, len(vectors), SLICE_TEXTS):
        sizes, by_size = _vectors(vectors.slice(low, SLICE_TEXTS))
        found.append(pa.array(_lengths(sizes, by_size), mask=sizes < 0))
    return pa.concat_arrays(found) if found else pa.array([], pa.float64())


def length(v: Column) -> Column:
    """The Euclidean length of a vector; null if it is null or holds a null."""
    return _length(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; zero if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = length(a) * length(b)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _rounded(score: float) -> float:
    """As Spark rounds to four digits."""
    return float(Decimal(repr(score)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) if math.isfinite(score) else score


class _Nearest:
    """The k best chunks of each query so far, by rounded score and id; NaN is the best score, none the worst.

    Scores of a slice are a matrix product; rows within TIE of the k-th best are scored again,
    with sums in order, and rounded, so ties go to the lesser id.
    """

    TIE = 2e-4  # more than twice what rounding moves

    def __init__(self, k: int, vectors: pa.Array, cases: list) -> None:
        self.k, self.cases = k, cases
        self.sizes, self.by_size = _vectors(vectors)
        self.lengths = _lengths(self.sizes, self.by_size)
        self.best: list[list[tuple]] = [[] for _ in cases]
        self.cut = np.full(len(cases), -np.inf)
        self.of_case: dict = {}
        for i, c in enumerate(cases):
            self.of_case.setdefault(c, []).append(i)

    def add(self, ids: list, vectors: pa.Array, cases: list) -> None:
        sizes, by_size = _vectors(vectors)
        lengths = _lengths(sizes, by_size)
        with np.errstate(all="ignore"):
            product = np.outer(self.lengths, lengths)
            scores = np.full(product.shape, -np.inf)  # none: vectors of different sizes
            for n, (at, rows) in by_size.items():
                if n in self.by_size:
                    of, asked = self.by_size[n]
                    scores[np.ix_(of, at)] = asked @ rows.T / product[np.ix_(of, at)]
        scores[np.isnan(scores)] = np.inf
        scores[(product == 0) | (self.sizes < 0)[:, None] | (sizes < 0)] = 0.0
        place: dict = {}
        for i, c in enumerate(cases):
            place.setdefault(c, []).append(i)
        where = {n: {int(i): j for j, i in enumerate(at)} for n, (at, _) in by_size.items()}
        for case, at in place.items():
            of = np.array(self.of_case.get(case, ()), np.int64)
            if case is None or not len(of):
                continue
            some, at = scores[np.ix_(of, at)], np.array(at)
            if len(at) >= self.k:
                self.cut[of] = np.maximum(self.cut[of], np.partition(some, len(at) - self.k, axis=1)[:, len(at) - self.k])
            close = some >= self.cut[of][:, None] - self.TIE
            for q, kept in zip(of[close.any(axis=1)], close[close.any(axis=1)], strict=True):
                self._merge(int(q), at[kept], scores[q], ids, sizes, by_size, lengths, where)

    def _merge(self, q: int, at: np.ndarray, rough: np.ndarray, ids: list, sizes: np.ndarray, by_size: dict, lengths: np.ndarray, where: dict) -> None:
        exact, size = rough[at], int(self.sizes[q])
        with np.errstate(all="ignore"):
            product = self.lengths[q] * lengths[at]
        real = np.flatnonzero((sizes[at] == size) & (product != 0) & (size > 0))
        if len(real):
            of, asked = self.by_size[size]
            rows = by_size[size][1][[where[size][int(i)] for i in at[real]]]
            with np.errstate(all="ignore"):
                exact[real] = _in_turn(rows * asked[np.searchsorted(of, q)]) / product[real]
        known = {s: (_rounded(s) if not math.isnan(s) else math.inf) for s in set(exact.tolist())}
        rows = [(-known.get(s, math.inf), ids[i] is not None, ids[i], None if s == -math.inf else s) for i, s in zip(at.tolist(), exact.tolist(), strict=True)]
        self.best[q] = sorted(self.best[q] + rows, key=lambda r: r[:3] if r[1] else (r[0], False))[: self.k]


def top_k(queries: DataFrame, chunks: DataFrame, k: int = QUERY_K, where: Column | None = None, per_case: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """The k chunks nearest each query by cosine; `where` filters chunks first. Ties go to the lesser id.

    queries: query_id, case_id, query_vector; chunks: chunk_id, case_id, embedding. The
    queries are a stated set: each meets the chunks of its case, or, with per_case off, all
    chunks. They are broadcast, `block` queries at a time, so chunks stay where they are and
    a case with most of them is split like any other. A task multiplies slices of its chunks
    with the queries and hands on at most k candidates of a query.
    """
    spark = queries.sparkSession
    found = chunks if where is None else chunks.filter(where)
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select("query_id", "query_vector", (F.col("case_id") if per_case else F.lit(0)).alias("_of"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block"))
    found = found.select("chunk_id", "embedding", (F.col("case_id") if per_case else F.lit(0)).cast(asked.schema["_of"].dataType).alias("_of"))
    kinds = T.StructType([asked.schema["query_id"], found.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    layout = to_arrow_schema(kinds)

    def part(i: int) -> DataFrame:
        held = spark.sparkContext.broadcast(asked.filter(F.col("_block") == i).drop("_block").toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, cases = (c.combine_chunks() for c in held.value.columns)
            near, size = _Nearest(k, vectors, cases.to_pylist()), max(1, min(SLICE_TEXTS, SLICE_SCORES // max(1, len(ids))))
            for batch in batches:
                for low in range(0, batch.num_rows, size):
                    one = batch.slice(low, size)
                    near.add(one.column(0).to_pylist(), one.column(1), one.column(2).to_pylist())
            for some in range(0, len(ids), SLICE_TEXTS):
                rows = [(q, r) for q in range(some, min(len(ids), some + SLICE_TEXTS)) for r in near.best[q]]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([q for q, _ in rows], pa.int64())).cast(layout[0].type), pa.array([r[2] for _, r in rows], layout[1].type), pa.array([r[3] for _, r in rows], pa.float64())], schema=layout
                )

        return found.mapInArrow(run, kinds)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    scored = reduce(DataFrame.unionByName, [part(i) for i in range(blocks)]).withColumn("score", F.round("score", 4))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def numbered_sources(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query its sources as one text, '[i] text' by rank."""
    lines = hits.join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("line", F.format_string("[%d] %s", "rank", "text"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"))


def chunk_count(chunks: DataFrame) -> DataFrame:
    """Chunks per case, and whether its index is ready."""
    return chunks.groupBy("case_id").agg(F.count("*").alias("chunks")).withColumn("ready", F.col("chunks") > 0)


def write_index(chunks: DataFrame, path: str) -> None:
    """The index as a table partitioned by case; cases in `chunks` replace their partition."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)
