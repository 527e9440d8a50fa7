"""Files of frames read in byte ranges, so that one file of any length is dealt over many tasks.

Spark lists the files; each is cut into ranges of RANGE_BYTES. A frame belongs to the range in
which it starts. A reader of whole files goes from frame to frame, so the first frame of a range
depends on all before it; a task finds it from a few bytes before the range alone: it follows the
frames from every place at which one could begin there, and once all of these ways have met, the
place where they meet is on the whole file's way too. Until they meet, it goes further back, in
the end to the start of the file. Any size of ranges gives the frames of the whole file.
A task reads ranges that follow each other, so only the first of them is found so. Where a
way can end within a file (captures), each task starts from a guess, and an aggregate over a
file's tasks checks that every one begins where the one before it went (`chained`).

Bytes are read with pyarrow's file systems (local, HDFS, S3, GCS and what else it opens by URI).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Generator, Iterator
from types import SimpleNamespace
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flightlens.session import stored
from flightlens.sources.binary_files import file_system

RANGE_BYTES = 32 << 20
#: Ranges are dealt over at most so many tasks.
MOST_TASKS = 20_000
FRAMES_AT_A_TIME = 20_000
#: A task takes ranges that follow each other, of about so many bytes, and goes from one to the next.
TASK_BYTES = 4 << 20


class Framing(Protocol):
    """How one file is cut into frames.

    first: where the file's first frame can begin. longest: no frame, and no step without one,
    is longer. head: bytes of the file's start that the framing is made from.
    """

    first: int
    longest: int

    def step(self, data: bytes, at: int, base: int) -> tuple[int | None, tuple | None]:
        """From a place in data (which begins at base in the file): the next place, and the frame here.

        A next place of None ends the file; a frame of None is none.
        """

    def starts(self, data: bytes, upto: int) -> list[int]:
        """Places before upto in data at which a frame could begin, all of them if nothing rules them out."""


def open_file(path: str) -> pa.NativeFile:
    """The file of a Spark path, for reads at any offset."""
    system, place = file_system(path)
    return system.open_input_file(place)


def byte_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(file, length, start, stop) of all ranges of files (path, length), dealt over tasks; empty files have none."""
    cut = files.filter("length > 0").select(F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + size, F.col("length")))


def entry(framing: Framing, read: Callable[[int, int], bytes], start: int, length: int) -> int | None:
    """The first place of the file's way that isn't before start; None if the way ends before."""
    back = 4 * framing.longest
    while True:
        low = max(framing.first, start - back)
        data = read(low, min(length, start + framing.longest))
        places = [0] if low == framing.first else framing.starts(data, framing.longest)
        target, met, todo = start - low, set(), list(dict.fromkeys(places))
        heapq.heapify(todo)
        known = set(todo)
        while todo:
            at = heapq.heappop(todo)
            if at >= target:
                met.add(at)
                continue
            following, _ = framing.step(data, at, low)
            if following is None:
                met.add(None)
            elif following not in known:
                known.add(following)
                heapq.heappush(todo, following)
        if low == framing.first or len(met) == 1:
            found = met.pop() if met else None
            return None if found is None else low + found
        back *= 8


def follow(framing: Framing, read: Callable[[int, int], bytes], at: int | None, stop: int, length: int, size: int) -> Generator[tuple, None, int | None]:
    """(off, ...) of the frames from a place of the way on, up to stop, with about `size` bytes read at a time.

    Returns the place behind: the first that isn't before stop, None if the way ends.
    """
    while at is not None and at < stop:
        upto = min(stop, at + max(size, framing.longest))
        data, base = read(at, min(length, upto + framing.longest)), at
        place: int | None = 0
        while place is not None and base + place < upto:
            place, frame = framing.step(data, place, base)
            if frame is not None and base + frame[0] < stop:
                yield base + frame[0], *frame[1:]
        at = None if place is None else base + place
    return at


def frames_of(framing: Framing, read: Callable[[int, int], bytes], start: int, stop: int, length: int, size: int | None = None) -> Iterator[tuple]:
    """(off, ...) of the frames that start in a range, read at once or `size` bytes at a time."""
    at = framing.first if start <= framing.first else entry(framing, read, start, length)
    yield from follow(framing, read, at, stop, length, size or stop - start)


def guess(framing: Framing, read: Callable[[int, int], bytes], start: int, length: int) -> int | None:
    """The one place at which the ways from shortly before start go on behind it; None if there are several or none.

    A way that ends there may be false or the file's own, so this can be wrong: the place behind
    the range before tells.
    """
    low = start - 2 * framing.longest
    if low <= framing.first:
        low, places = framing.first, [0]
        data = read(low, min(length, start + framing.longest))
    else:
        data = read(low, min(length, start + framing.longest))
        places = framing.starts(data, framing.longest)
    ends, seen = set(), set()
    for place in places:
        at: int | None = place
        while at is not None and at < start - low and at not in seen:
            seen.add(at)
            at, _ = framing.step(data, at, low)
        if at is not None and at >= start - low:
            ends.add(at)
    return low + ends.pop() if len(ends) == 1 else None


def stretches(files: DataFrame, size: int, known: DataFrame | None = None) -> DataFrame:
    """byte_ranges of about TASK_BYTES, of whole ranges of `size`, each for one task, with what is known of their file."""
    found = byte_ranges(files, size * max(1, TASK_BYTES // size))
    count = found.count()
    if known is not None:
        found = found.join(known, "file", "left")
    return found.repartition(max(1, min(count, MOST_TASKS)))


def reading(opened: pa.NativeFile) -> Callable[[int, int], bytes]:
    """A reader of the bytes from one place to another."""

    def read(a: int, b: int) -> bytes:
        opened.seek(a)
        return opened.read(max(0, b - a))

    return read


def chained(files: DataFrame, make: Callable[..., Framing | None], size: int, head: int) -> DataFrame:
    """(file, length, start, stop, at, before) of stretches: the place from which each goes on, and how many frames come before.

    For framings whose way can end within a file, which no look at a few bytes can tell. Every
    stretch is followed from a guess; the place behind a stretch has to be the next one's guess,
    else the next one is followed again from there. A file has one row a stretch here.
    """

    def followed(framing: Framing, row: tuple, at: int, opened: pa.NativeFile) -> tuple[int, int]:
        frames, count = follow(framing, reading(opened), at, row.stop, row.length, size), 0
        while True:
            try:
                next(frames)
                count += 1
            except StopIteration as end:
                return -1 if end.value is None else end.value, count

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                with open_file(row.file) as opened:
                    framing = make(reading(opened)(0, min(head, row.length)), None)
                    if framing is None:
                        continue
                    at = framing.first if row.start <= framing.first else guess(framing, reading(opened), row.start, row.length)
                    rows.append((*row, *((-1, -1, 0) if at is None else (at, *followed(framing, row, at, opened)))))
            yield pd.DataFrame(rows, columns=[*batch.columns, "at", "behind", "frames"])

    def joined(found: pd.DataFrame) -> pd.DataFrame:
        rows, at, before = [], None, 0
        for row in found.sort_values("start").itertuples(index=False):
            if at is None:  # a file's first stretch is followed from its first frame
                at = row.at
            behind, frames = row.behind, row.frames
            if at < 0 or at >= row.stop:
                continue
            if at != row.at:
                with open_file(row.file) as opened:
                    behind, frames = followed(make(reading(opened)(0, min(head, row.length)), None), row, at, opened)
            rows.append((row.file, row.length, row.start, row.stop, at, before))
            at, before = behind, before + frames
        return pd.DataFrame(rows, columns=["file", "length", "start", "stop", "at", "before"])

    kinds = "file string, length long, start long, stop long, at long"
    guessed = stretches(files, size).mapInPandas(run, f"{kinds}, behind long, frames long")
    return guessed.groupBy("file").applyInPandas(joined, f"{kinds}, before long")


def batch_of(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; the entries of dicts, which are maps, are laid out one after the other."""

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_map(kind):
            return pa.array(values, kind)
        ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
        keys = pa.array([k for v in values for k in v], kind.key_type)
        return pa.MapArray.from_arrays(pa.array(ends), keys, pa.array([x for v in values for x in v.values()], kind.item_type)).cast(kind)

    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def read_frames(files: DataFrame, make: Callable[..., Framing | None], schema: str, size: int = RANGE_BYTES, head: int = 0, known: DataFrame | None = None, ends: bool = False) -> DataFrame:
    """A row (file, off, ...) for each frame of files (path, length).

    make(head bytes, known value) gives a file's framing, None for a file that has no frames;
    known (file, known) adds to each file what an earlier pass found. ends: the framing's way can
    end within a file; rows then also have n, the number of the frame in its file, from 0.
    """
    if ends:
        found = stored(chained(files, make, size, head))  # a row a stretch
        dealt = found.repartition(max(1, min(found.count(), MOST_TASKS)))
    else:
        dealt = stretches(files, size, known)
    given = f"file string, off long, {schema}" + (", n long" if ends else "")
    kinds = to_arrow_schema(StructType.fromDDL(given))
    informed = known is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (SimpleNamespace(**r) for r in batch.to_pylist()):
                with open_file(row.file) as opened:
                    read = reading(opened)
                    framing = make(read(0, min(head, row.length)), row.known if informed else None)
                    if framing is None:
                        continue
                    if ends:
                        frames = ((*f, row.before + i) for i, f in enumerate(follow(framing, read, row.at, row.stop, row.length, size)))
                    else:
                        frames = frames_of(framing, read, row.start, row.stop, row.length, size)
                    rows: list[tuple] = []
                    since = row.start
                    for frame in frames:
                        rows.append((row.file, *frame))
                        if len(rows) == FRAMES_AT_A_TIME or frame[0] - since > TASK_BYTES:
                            since = frame[0]
                            yield batch_of(rows, kinds)
                            rows = []
                    yield batch_of(rows, kinds)

    return dealt.mapInArrow(run, given)


def by_offset(off: str = "off") -> dict[str, Column]:
    """The stretch of a place in a file, for operators that go over a file's rows in order."""
    return {"_stretch": F.floor(F.col(off) / RANGE_BYTES)}


def file_at_once(framing: Framing, data: bytes) -> list[tuple]:
    """The frames of a whole file that is at hand."""
    return list(frames_of(framing, lambda a, b: data[a:b], 0, len(data), len(data)))
