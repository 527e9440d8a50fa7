"""A row's place in its case, the row before it and the last values up to it, without a window over a whole case.

A case may hold a large part of all rows. Windows here run over stretches of a case's
list; what a stretch needs from those before it (how many rows, the last row or value)
comes from an aggregate with one row per stretch, which is joined back on the stretch's key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of consecutive seq values, and seconds, that one window takes at most.
STRETCH, STRETCH_SECONDS = 100_000, 3_600
BEFORE = (Window.unboundedPreceding, -1)


def by_number(number: Column) -> Column:
    """The stretch of a running number."""
    return F.floor(number / STRETCH)


def by_time(ts: Column) -> Column:
    """The stretch of a time."""
    return F.floor(F.unix_micros(ts) / F.lit(STRETCH_SECONDS * 1_000_000))


def _joined(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what is carried for their stretch; null keys are keys as well."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    carried = carried.withColumnsRenamed(names)
    same = [rows[k].eqNullSafe(carried[n]) for k, n in names.items()]
    return rows.join(carried, same, "left").drop(*names.values())


def numbered(rows: DataFrame, name: str, keys: Sequence[str], stretch: dict[str, Column], order: Sequence[str], total: str | None = None) -> DataFrame:
    """rows with their number, from 1, among those of equal keys, and, if named, how many these are.

    The columns of stretch, in their order, cut the list that `order` sorts further inside.
    """
    cut = rows.withColumns(stretch)
    spans = [*keys, *stretch]
    sizes = cut.groupBy(*spans).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy(*stretch).rowsBetween(*BEFORE)), F.lit(0))
    offsets = sizes.select(*spans, before.alias("_before"), F.sum("_n").over(group).alias("_total"))
    inside = cut.withColumn("_i", F.row_number().over(Window.partitionBy(*spans).orderBy(*order)))
    totals = [F.col("_total").alias(total)] if total else []
    return _joined(inside, offsets, spans).select(*rows.columns, (F.col("_before") + F.col("_i")).alias(name), *totals)


def previous(rows: DataFrame, value: Column, name: str, keys: Sequence[str], stretch: dict[str, Column], order: str) -> DataFrame:
    """rows with the value (a struct) of the row before, null at the first."""
    cut = rows.withColumns({**stretch, "_value": value})
    spans = [*keys, *stretch]
    lasts = cut.groupBy(*spans).agg(F.max_by("_value", order).alias("_last"))
    carried = lasts.select(*spans, F.lag("_last").over(Window.partitionBy(*keys).orderBy(*stretch)).alias("_carried"))
    inside = cut.withColumn("_inside", F.lag("_value").over(Window.partitionBy(*spans).orderBy(order)))
    return _joined(inside, carried, spans).select(*rows.columns, F.coalesce("_inside", "_carried").alias(name))


def with_last(rows: DataFrame, values: dict[str, Column], keys: Sequence[str], stretch: dict[str, Column], order: Sequence[str], descending: bool = False) -> DataFrame:
    """rows with, for each name, the last non-null value of the rows up to and with the row itself."""
    turn, last_by = (F.desc, F.min_by) if descending else (F.asc, F.max_by)
    cut = rows.withColumns({**stretch, **{f"_v_{n}": v for n, v in values.items()}})
    spans = [*keys, *stretch]
    place = F.struct(*order)
    lasts = cut.groupBy(*spans).agg(*[last_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_v_{n}") for n in values])
    over = Window.partitionBy(*keys).orderBy(*[turn(c) for c in stretch]).rowsBetween(*BEFORE)
    carried = lasts.select(*spans, *[F.last(f"_v_{n}", True).over(over).alias(f"_c_{n}") for n in values])
    running = Window.partitionBy(*spans).orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({f"_i_{n}": F.last(f"_v_{n}", True).over(running) for n in values})
    kept = [c for c in rows.columns if c not in values]
    return _joined(inside, carried, spans).select(*kept, *[F.coalesce(f"_i_{n}", f"_c_{n}").alias(n) for n in values])


def with_running(rows: DataFrame, name: str, value: Column, keys: Sequence[str], stretch: dict[str, Column], order: Sequence[str], fold: Callable[[Column], Column] = F.min) -> DataFrame:
    """rows with the fold (F.min, F.max or F.sum) of value over the rows before the row itself; null at the first."""
    cut = rows.withColumns({**stretch, "_v": value})
    spans = [*keys, *stretch]
    whole = cut.groupBy(*spans).agg(fold("_v").alias("_v"))
    carried = whole.select(*spans, fold("_v").over(Window.partitionBy(*keys).orderBy(*stretch).rowsBetween(*BEFORE)).alias("_c"))
    inside = cut.withColumn("_i", fold("_v").over(Window.partitionBy(*spans).orderBy(*order).rowsBetween(*BEFORE)))
    pair = F.filter(F.array("_i", "_c"), lambda x: x.isNotNull())
    both = F.when(F.size(pair) == 2, {F.min: F.array_min, F.max: F.array_max}.get(fold, lambda a: F.get(a, F.lit(0)) + F.get(a, F.lit(1)))(pair)).otherwise(F.get(pair, F.lit(0)))
    return _joined(inside, carried, spans).select(*rows.columns, both.alias(name))


def in_list() -> dict[str, Column]:
    """The stretches of a case's list of rows."""
    return {"_file": F.col("ingest_seq"), "_stretch": by_number(F.col("seq"))}


def with_place(rows: DataFrame) -> DataFrame:
    """rows with place, counted from 0 within the case in list order, and case_rows."""
    found = numbered(rows, "place", ["case_id"], in_list(), ["seq"], "case_rows")
    return found.withColumn("place", F.col("place") - 1)


def with_previous(rows: DataFrame, columns: tuple[str, ...], per_file: bool = False) -> DataFrame:
    """rows with prev_<column> of the row before in list order; per_file: of the same file, given as evidence_id."""
    file = ["evidence_id"] if per_file and "evidence_id" in rows.columns else []
    found = previous(rows, F.struct(*columns), "_prev", ["case_id", *file], in_list(), "seq")
    return found.select(*rows.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns])
