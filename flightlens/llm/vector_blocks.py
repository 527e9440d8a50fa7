"""Integer vectors in shards and query blocks, and searches of blocks against shards in rounds.

Rows are dealt to shards by the nearest of a few reference directions, fitted on a bounded sample;
every row is in one shard, and a direction near which many rows lie has as many shards as it takes.
Queries are dealt to blocks alike. A search meets each block first with one shard of its own
direction, which gives every query a score to beat, and then with all other shards, in groups of
both, so that no task holds all queries or all rows. Shards and blocks are rows of a binary column.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightlens.llm.common import materialize

SCALE = 256
REFERENCES = 16
#: Rows that the reference directions are fitted on, those of least hash.
SAMPLE_ROWS = 4096
SHARD_ROWS, SHARD_BYTES = 8192, 32 << 20
BLOCK_ROWS = 256
#: So many blocks, and at most so many shards, meet in one task at a time.
BLOCKS_TOGETHER, SHARDS_TOGETHER = 64, 16
#: No score; lower than every score.
NONE = np.iinfo(np.int64).min + 1
NO_ID = np.iinfo(np.int64).max
EXACT = 2.0**53

BLOCK_SCHEMA = "block int, home int, data binary"
RESULT_SCHEMA = "block int, row int, slot int, query_id long, slot_id long, slot_score long, vec_id long, score long"


class Layout(NamedTuple):
    """Shards, query blocks and reference directions of a table of vectors."""

    shards: DataFrame
    blocks: DataFrame
    together: int
    spent: list[DataFrame]


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    length = norms(vectors)
    return vectors / np.where(length == 0, 1, length)[:, None]


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole numbers; beyond 64 bits they stop at the ends of the range."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in side] for side in (queries, vectors))
    return np.array([[min(max(sum(a * b for a, b in zip(p, q, strict=True)), NONE + 1), NO_ID) for q in right] for p in left], np.int64)


def no_best(rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of rows for which nothing is found yet."""
    return np.full((rows, k), NONE), np.full((rows, k), NO_ID)


def start(rows: int, k: int, least: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """A block's state before a search: its best, and the least score that may still enter."""
    best_score, best_id = no_best(rows, k)
    return {"best_score": best_score, "best_id": best_id, "least": np.full(rows, NONE) if least is None else least}


def empty_block(k: int) -> dict[str, np.ndarray]:
    return {"ids": np.zeros(0, np.int64), **start(0, k)}


def keep_best(best_score: np.ndarray, best_id: np.ndarray, rows: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
    """Put scores found for rows into the rows' best, in place: higher scores first, ties by smaller id."""
    if not len(rows):
        return
    k, touched = best_score.shape[1], np.unique(rows)
    r = np.r_[rows, np.repeat(touched, k)]
    s, i = np.r_[found, best_score[touched].ravel()], np.r_[ids, best_id[touched].ravel()]
    order = np.lexsort((i, -s, r))
    r, s, i = r[order], s[order], i[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    kept = place < k
    best_score[r[kept], place[kept]], best_id[r[kept], place[kept]] = s[kept], i[kept]


def finite(vector: Column) -> Column:
    """The vector is there and holds only finite components, also after scaling."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < float("inf")))


def _whole(lists: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of every component; shorter vectors are filled up with zeros."""
    lengths = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < lengths[:, None]] = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
    return out


def fit_references(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions: rows that are far from one another, each moved to the mean of those nearest to it."""
    rows = unit(sample)
    rows = rows[norms(rows) > 0.5]
    if not len(rows):
        return np.eye(1, max(1, sample.shape[1]))[:, : sample.shape[1]]
    chosen, nearest = [0], rows @ rows[0]
    while len(chosen) < min(count, len(rows)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    found = rows[chosen]
    for _ in range(5):
        near = (rows @ found.T).argmax(1)
        found = np.stack([unit(rows[near == j].mean(0)[None])[0] if (near == j).any() else found[j] for j in range(len(found))])
    return found


def lay_out(vectors: DataFrame, id_col: str, vec_col: str, label: Column | None, is_query: Column, index: Callable[..., dict[str, np.ndarray]], state: Callable[[int], dict[str, np.ndarray]], shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> Layout | None:
    """Shards, each with what index(vectors, references, ids, labels) gives, and query blocks, each with state(rows); None without rows.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take
    no part; nor do rows of a null label where a label is given. Exact repeats of a row count once.
    """
    vector = F.col(vec_col).cast("array<double>")
    labels = (F.lit(0) if label is None else label).cast("long")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"), labels.alias("label"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    dim, most = rows.select(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if dim is None:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    references = fit_references(_whole(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, dim))
    kind = np.dtype("<i2" if (most or 0) < 2**15 // SCALE - 1 else "<f8")

    def place(batches):
        for batch in batches:
            whole = _whole(batch.column("v"), dim)
            near = (whole @ references.T).argmax(1).astype(np.int32) if dim else np.zeros(len(whole), np.int32)
            data = [row.tobytes() for row in whole.astype(kind)]
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("asks"), pa.array(near), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "asks", "near", "data"])

    placed = rows.mapInArrow(place, "vec_id long, label long, asks boolean, near int, data binary").dropDuplicates(["vec_id", "label", "data"])
    placed = materialize(placed)
    counts = {r["near"]: (r["rows"], r["queries"]) for r in placed.groupBy("near").agg(F.count("*").alias("rows"), F.count_if("asks").alias("queries")).collect()}
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (8 * max(dim, 1))))
    shards, blocks = ([ceil(counts.get(j, (0, 0))[k] / size) for j in range(len(references))] for k, size in ((0, shard_rows), (1, block_rows)))
    first_shard, first_block = (np.cumsum([0, *n])[:-1].tolist() for n in (shards, blocks))

    def of_near(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("near") + 1)

    def part(values: list[int]) -> Column:
        return F.pmod(F.xxhash64("vec_id", "data"), F.greatest(F.lit(1), of_near(values))).cast("int")

    def matrix(data: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(data), kind).reshape(len(data), dim)

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "data"])
        found = index(matrix(rows["data"]).astype(np.float64), references, rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "data": [pack(**found)]})

    def pack_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "data"])
        held = {"vectors": matrix(rows["data"]), "ids": rows["vec_id"].to_numpy(np.int64), "labels": rows["label"].to_numpy(np.int64)}
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "home": [rows["home"].iloc[0]], "data": [pack(**held, **state(len(rows)))]})

    dealt = placed.select((of_near(first_shard) + part(shards)).cast("int").alias("shard"), "vec_id", "label", "data")
    packed = materialize(dealt.groupBy("shard").applyInPandas(pack_shard, "shard int, data binary"))
    asking = placed.filter("asks").withColumn("part", part(blocks))
    home = of_near(first_shard) + F.col("part") % F.greatest(F.lit(1), of_near(shards))
    asking = asking.select((of_near(first_block) + F.col("part")).cast("int").alias("block"), home.cast("int").alias("home"), "vec_id", "label", "data")
    queries = materialize(asking.groupBy("block").applyInPandas(pack_block, BLOCK_SCHEMA))
    together = max(1, min(SHARDS_TOGETHER, sum(shards) // (2 * vectors.sparkSession.sparkContext.defaultParallelism)))
    return Layout(packed, queries, together, [placed, packed, queries])


def _block_frame(rows: list[tuple[int, int, dict[str, np.ndarray]]]) -> pd.DataFrame:
    return pd.DataFrame({"block": [b for b, _, _ in rows], "home": [h for _, h, _ in rows], "data": [pack(**d) for _, _, d in rows]}, columns=["block", "home", "data"])


def at_home(layout: Layout, blocks: DataFrame, search: Callable[[dict, dict], None]) -> DataFrame:
    """The blocks after a search of the shard each is at home in."""

    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        rows = [(b, h, unpack(d)) for b, h, d in zip(queries["block"], queries["home"], queries["data"], strict=True)]
        held = unpack(shard["data"].iloc[0]) if rows else {}
        for _, _, block in rows:
            search(block, held)
        return _block_frame(rows)

    return materialize(blocks.groupBy("home").cogroup(layout.shards.withColumnRenamed("shard", "home").groupBy("home")).applyInPandas(run, BLOCK_SCHEMA))


def result_rows(block: int, data: dict[str, np.ndarray]) -> pd.DataFrame:
    """Rows of RESULT_SCHEMA for a block's best, which has the slots of a row one after another."""
    rows, k = len(data["ids"]), data["best_score"].shape[1]
    best = data["best_score"].reshape(rows, len(data["best_score"]) // max(1, rows), k)
    row, slot, place = np.nonzero(best > NONE)
    asked = "slot_id" in data
    return pd.DataFrame(
        {
            "block": np.full(len(row), block, np.int32),
            "row": row.astype(np.int32),
            "slot": slot.astype(np.int32),
            "query_id": data["ids"][row],
            "slot_id": data["slot_id"][row, slot] if asked else np.zeros(len(row), np.int64),
            "slot_score": data["slot_score"][row, slot] if asked else np.zeros(len(row), np.int64),
            "vec_id": data["best_id"].reshape(best.shape)[row, slot, place],
            "score": best[row, slot, place],
        }
    )


def elsewhere(layout: Layout, blocks: DataFrame, search: Callable[[dict, dict], None], k: int, bound: Callable[[dict, dict], float]) -> DataFrame:
    """The k best of every query and slot over all shards, as rows of RESULT_SCHEMA with a rank.

    blocks have been searched at home; the scores they found there bound all other searches, and
    within a task what one shard gives bounds the next: shards come in the order of
    bound(block, shard), highest first.
    """
    together = layout.together
    groups = layout.shards.select(F.max("shard")).first()[0] // together + 1
    sets = (blocks.select(F.max("block")).first()[0] or 0) // BLOCKS_TOGETHER + 1

    def run(queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        held = [(n, unpack(d)) for n, d in zip(shards["shard"], shards["data"], strict=True)] if len(queries) else []
        out = [result_rows(0, empty_block(k))]
        for number, home, packed in zip(queries["block"], queries["home"], queries["data"], strict=True):
            block = unpack(packed)
            # What was found at home is returned from there; here it is only the score to beat.
            block["least"] = np.maximum(block["least"], block["best_score"][:, -1])
            block["best_score"], block["best_id"] = no_best(len(block["best_score"]), k)
            for _, shard in sorted((x for x in held if x[0] != home), key=lambda x: -float(bound(block, x[1]))):
                search(block, shard)
            out.append(result_rows(number, block))
        return pd.concat(out)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = blocks.withColumn("set", F.floor(F.col("block") / BLOCKS_TOGETHER).cast("int")).select("*", every(groups).alias("group"))
    met = layout.shards.withColumn("group", F.floor(F.col("shard") / together).cast("int")).select("*", every(sets).alias("set"))
    others = asked.groupBy("group", "set").cogroup(met.groupBy("group", "set")).applyInPandas(run, RESULT_SCHEMA)
    own = blocks.select("block", "data").mapInPandas(lambda batches: (result_rows(b, unpack(d)) for batch in batches for b, d in zip(batch["block"], batch["data"], strict=True)), RESULT_SCHEMA)
    best = Window.partitionBy("block", "row", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return own.union(others).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def with_slots(blocks: DataFrame, results: DataFrame, slots: int, state: Callable[[dict], dict[str, np.ndarray]]) -> DataFrame:
    """The blocks with the results as slots (slot_id, slot_score; NO_ID and NONE where there are fewer) and a new state."""

    def run(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for b, h, d in zip(queries["block"], queries["home"], queries["data"], strict=True):
            data = unpack(d)
            data["slot_id"], data["slot_score"] = np.full((len(data["ids"]), slots), NO_ID), np.full((len(data["ids"]), slots), NONE)
            at = found["row"].to_numpy(np.int64), found["rank"].to_numpy(np.int64) - 1
            data["slot_id"][at], data["slot_score"][at] = found["vec_id"], found["score"]
            rows.append((b, h, data | state(data)))
        return _block_frame(rows)

    return materialize(blocks.groupBy("block").cogroup(results.select("block", "row", "rank", "vec_id", "score").groupBy("block")).applyInPandas(run, BLOCK_SCHEMA))
