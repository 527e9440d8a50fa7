"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.session import shared_dir

#: ASCII white space, the word separators of most operators here.
SPACE = r"\x20\x09-\x0D"
HELD_OUT_REMAINDER = 2
#: Texts are worked on in slices of about so many characters, to bound a worker's memory.
SLICE_CHARS = 2_000_000


#: Spark's setting by which a query's shuffle files are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that materialize has made and nobody has deleted yet.
_made: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again.

    Cuts the lineage the way checkpoint() does, but columnar, so later readers
    prune columns; a lost executor loses no part of it. The shuffle files of the job go with
    its end, not when the driver happens to collect its garbage: many small jobs leave many.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flightlens/{uuid.uuid4().hex}"
    _made.append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)
    _made.remove(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that no later plan reads; other tables are refused."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            own = [path for path in _made if path.rsplit("/", 1)[-1] == file.split("/")[-2]]
            if not own:
                raise ValueError(f"not a table made by materialize: {file}")
            _delete(df.sparkSession, own[0])


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, as a table of its own; all other tables made on the way are deleted."""
    before = set(_made)
    result = materialize(make())
    for path in [p for p in _made[:-1] if p not in before]:
        _delete(result.sparkSession, path)
    return result


def text_slices(batch: pd.DataFrame, column: str = "text") -> Iterator[pd.DataFrame]:
    """A batch in parts of about SLICE_CHARS characters of text each; a longer text is a part of its own."""
    held = np.cumsum([len(t) if t else 0 for t in batch[column]]) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.iloc[a:b]


def new_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of docs."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in ("_" * k + name for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def without_places(items: Column, gone: Column) -> Column:
    """The array without the items at these places, from 0; in time proportional to both (null gone: none)."""
    kept = lambda of: F.array_except(F.sequence(F.lit(0), F.size(of) - 1), gone)
    rest = F.transform(F.array(items), lambda of: F.when(F.size(of) > 0, F.transform(kept(of), lambda i: F.get(of, i))).otherwise(of))
    return F.when(gone.isNull(), items).otherwise(F.get(rest, F.lit(0)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def is_held_out(doc_id: object) -> bool:
    """The same rule in plain Python, for tests."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT_REMAINDER


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def release_memory() -> None:
    """Hand freed memory back to the system: Spark keeps its Python workers, which idle through other stages."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
