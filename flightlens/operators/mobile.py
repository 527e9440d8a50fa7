"""Companion-app artifacts: accounts, operator positions, per-app and per-case aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.session import forget, stored

SAME_PLACE_DEGREES = 1e-5
UNKNOWN_PLATFORM = "Generic Mobile"


def account_fields(pairs: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """email, pilot_name, user_id and phone per case (or other keys) from (case_id, pos, key, value) rows.

    A key names the field by the first keyword in it; empty values count only for a name
    by 'name' and an id by 'uid'. The last value of a field wins, of user_id the first.
    """
    key = F.lower("key")
    filled = F.coalesce(F.col("value") != "", F.lit(False))
    field = (
        F.when(key.contains("email") & filled, "email")
        .when(key.contains("name") | (key.contains("nick") & filled), "pilot_name")
        .when(key.contains("uid") | (key.contains("id") & filled), "user_id")
        .when(key.contains("phone") & filled, "phone")
    )
    rows = pairs.withColumn("field", field).filter(F.col("field").isNotNull())
    last = [F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("pos"))).alias(f) for f in ("email", "pilot_name", "phone")]
    first = F.min_by(F.when(F.col("field") == "user_id", F.col("value")), F.when(F.col("field") == "user_id", F.col("pos"))).alias("user_id")
    return rows.groupBy(*keys).agg(*last, first)


ACCOUNT_FIELDS = ("email", "phone", "pilot_name", "user_id")


def with_pilots(artifacts: DataFrame, accounts: DataFrame, fixes: DataFrame) -> DataFrame:
    """artifacts with pilot_account, a map of the filled fields of the app's account, and operator_fixes, how many places of the operator the app tells.

    accounts: account_fields with case_id and app_name. fixes: (case_id, app_name, pos, latitude,
    longitude, source), thinned for each app on its own as operator_locations does.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("value")) for f in ACCOUNT_FIELDS])
    filled = F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    known = accounts.select(F.col("case_id").alias("_case"), F.col("app_name").alias("_app"), F.map_from_entries(filled).alias("pilot_account"))
    own = fixes.withColumn("case_id", F.struct("case_id", "app_name")).select("case_id", "pos", "latitude", "longitude", "source")
    counted = operator_locations(own).groupBy(F.col("case_id.case_id").alias("_case"), F.col("case_id.app_name").alias("_app")).agg(F.count("*").alias("operator_fixes"))
    found = artifacts
    for part in (known, counted):
        found = found.join(part, found["case_id"].eqNullSafe(part["_case"]) & found["app_name"].eqNullSafe(part["_app"]), "left").drop("_case", "_app")
    return found.withColumns({"pilot_account": F.coalesce("pilot_account", F.create_map().cast("map<string,string>")), "operator_fixes": F.coalesce("operator_fixes", F.lit(0)).cast("long")})


def with_app_catalog(artifacts: DataFrame, catalog: DataFrame) -> DataFrame:
    """artifacts with package and platform of the catalog's entry for their app, case-insensitively."""
    known = catalog.select(F.lower("app_name").alias("_app"), "package_id", F.col("platform").alias("_platform")).dropDuplicates(["_app"])
    joined = artifacts.join(known, F.lower(artifacts["app_name"]) == known["_app"], "left")
    return joined.select(*artifacts.columns, "package_id", F.coalesce("_platform", F.lit(UNKNOWN_PLATFORM)).alias("platform"))


def mobile_artifacts(files: DataFrame) -> DataFrame:
    """Per case and app: its logs, plans and media by name, hardware as a map, and totals.

    files: case_id, app_name, kind (LOG, PLAN, MEDIA or HARDWARE), name, value, points.
    """
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    grouped = files.groupBy("case_id", "app_name").agg(names("LOG").alias("logs"), names("PLAN").alias("plans"), names("MEDIA").alias("media"), F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("points"), F.count("*").alias("files"))
    values = files.filter((F.col("kind") == "HARDWARE") & F.col("name").isNotNull()).groupBy("case_id", "app_name", "name").agg(F.max("value").alias("value"))
    maps = values.groupBy("case_id", "app_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("hardware")).toDF("_case", "_app", "hardware")
    joined = grouped.join(maps, grouped["case_id"].eqNullSafe(maps["_case"]) & grouped["app_name"].eqNullSafe(maps["_app"]), "left")
    return joined.select(*grouped.columns, F.coalesce("hardware", F.create_map().cast("map<string,string>")).alias("hardware"))


def mobile_overview(artifacts: DataFrame) -> DataFrame:
    """Per case: apps, different platforms in order, and totals."""
    return artifacts.groupBy("case_id").agg(
        F.array_sort(F.collect_set("app_name")).alias("apps"), F.array_sort(F.collect_set("platform")).alias("platforms"), F.sum("points").alias("points"), F.sum("files").alias("files")
    )


def merge_artifacts(known: DataFrame, new: DataFrame) -> DataFrame:
    """known with the apps of new that its case doesn't have yet."""
    return known.unionByName(new.join(known.select("case_id", "app_name"), ["case_id", "app_name"], "left_anti"))


def _cells(lat: Column, lon: Column) -> list[Column]:
    return [F.floor(c / SAME_PLACE_DEGREES).cast("long").alias(name) for c, name in ((lat, "cy"), (lon, "cx"))]


def _near(centres: DataFrame, fixes: DataFrame) -> DataFrame:
    """Pairs of a centre (columns c_...) and a fix of its case at the same place, the fix itself left out.

    Fixes of one cell are at one place, and those at one place lie in neighbouring cells; with
    at most one centre a cell, no fix meets more than nine.
    """
    around = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)]))
    spread = centres.select(*[F.col(c).alias(f"c_{c}") for c in ("case_id", "pos", "latitude", "longitude")], "cy", "cx", around.alias("d"))
    spread = spread.withColumns({"cy": F.col("cy") + F.col("d.y"), "cx": F.col("cx") + F.col("d.x")}).drop("d")
    met = fixes.join(spread, (F.col("case_id").eqNullSafe(F.col("c_case_id"))) & (fixes["cy"] == spread["cy"]) & (fixes["cx"] == spread["cx"])).drop(spread["cy"]).drop(spread["cx"])
    same = [F.abs(F.col(c) - F.col(f"c_{c}")) < SAME_PLACE_DEGREES for c in ("latitude", "longitude")]
    return met.filter(same[0] & same[1] & (F.col("pos") != F.col("c_pos")))


def operator_locations(fixes: DataFrame) -> DataFrame:
    """Operator fixes (case_id, pos, latitude, longitude, source) without those at the place of an earlier one kept.

    The list's rule, a fix stays if no fix kept before it is at its place, is met in rounds: a fix
    that comes before all undecided fixes at its place is kept, and those are dropped with it.
    Only the first undecided fix of a cell can be kept, so a round is linear; there are as many
    as the longest chain of fixes, each at the place of the one before, needs. Of equal pos the
    smaller position is first; fixes without a position or pos are left out.
    """
    known = fixes.filter(F.col("pos").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    first = known.groupBy("case_id", "latitude", "longitude").agg(F.min_by(F.struct("pos", "source"), "pos").alias("p"))
    ordered = first.select("case_id", F.struct(F.col("p.pos").alias("at"), "latitude", "longitude").alias("pos"), "latitude", "longitude", F.col("p.source").alias("source"), *_cells(F.col("latitude"), F.col("longitude")))
    undecided, kept = stored(ordered), []
    while not undecided.isEmpty():
        least = undecided.groupBy("case_id", "cy", "cx").agg(F.min_by(F.struct("pos", "latitude", "longitude", "source"), "pos").alias("f")).select("case_id", "cy", "cx", "f.*")
        late = _near(least, undecided).filter(F.col("pos") < F.col("c_pos")).select(F.col("c_case_id").alias("case_id"), F.col("c_pos").alias("pos")).distinct()
        chosen = stored(_without(least, late))
        gone = _near(chosen, undecided).select("case_id", "pos").union(chosen.select("case_id", "pos")).distinct()
        kept.append(chosen)
        undecided, before = stored(_without(undecided, gone)), undecided
        forget(before)
    if not kept:
        return fixes.select("case_id", "pos", "latitude", "longitude", "source").limit(0)
    return reduce(DataFrame.unionByName, kept).select("case_id", F.col("pos.at").alias("pos"), "latitude", "longitude", "source")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    gone = gone.toDF("_case", "_pos")
    return rows.join(gone, rows["case_id"].eqNullSafe(gone["_case"]) & (rows["pos"] == gone["_pos"]), "left_anti")
