"""Quality rules: base counts and zstandard compression bands.

A text is kept when it passes the base rule and its zstandard ratio (bytes over
compressed bytes) lies inside the band of its length, for the whole text and for the
fixed chunks of texts of two chunks or more: two adjacent chunks outside, or more than a
tenth of them, reject it. Repetitive text compresses too well, noise not at all. Noise of
few different characters, as hex, compresses by these alone: long texts must compress
better than the entropy of their bytes tells. Texts of less than 4 KiB don't show that:
hex compresses like prose there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from flightlens.llm.common import text_slices

#: (from bytes, lowest ratio, highest ratio) by length of the whole text in bytes. The
#: lowest ratios lie between base64 words and the least of prose; below 150 bytes these meet.
DOC_BANDS = (
    (0, 0.0, 3.0),
    (150, 1.065, 3.0),
    (175, 1.1, 3.0),
    (200, 1.135, 3.5),
    (250, 1.16, 3.5),
    (300, 1.205, 3.5),
    (400, 1.26, 3.5),
    (500, 1.32, 4.5),
    (700, 1.38, 4.5),
    (1_000, 1.45, 4.5),
    (2_000, 1.5, 6.0),
    (20_000, 1.5, 8.0),
    (200_000, 1.5, 10.0),
)
CHUNK_BYTES = 1_024
#: Band of one chunk, the share of chunks and the adjacent chunks that may lie outside it.
CHUNK_BAND = (1.35, 8.0)
CHUNK_MAX_OUTSIDE = 0.1
CHUNK_MAX_RUN = 1
#: Texts of so many bytes compress so many times better than by the entropy of their bytes.
GAIN_BYTES = 4_096
MIN_GAIN = 1.01
LEVEL = 3
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, zstd_ratio double, n_chunks long, n_chunks_outside long"
)


@dataclass(frozen=True)
class Bands:
    """Parameters of the compression verdict."""

    doc: tuple[tuple[int, float, float], ...] = DOC_BANDS
    chunk_bytes: int = CHUNK_BYTES
    chunk: tuple[float, float] = CHUNK_BAND
    max_outside: float = CHUNK_MAX_OUTSIDE
    max_run: int = CHUNK_MAX_RUN
    gain_bytes: int = GAIN_BYTES
    min_gain: float = MIN_GAIN
    level: int = LEVEL


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of `window` words that occurs at least twice, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    span = 1
    while span < window:  # ids of 2, 4, 8 ... words: equal ids mean equal words, no hashing involved
        step = min(span, window - span)
        pair = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span += step
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in data:
        return 0
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def entropy(data: bytes) -> float:
    """Bits per byte by the counts of the bytes alone."""
    counts = np.bincount(np.frombuffer(data, np.uint8))
    shares = counts[counts > 0] / max(len(data), 1)
    return float(-(shares * np.log2(shares)).sum())


def longest_run(flags: list[bool]) -> int:
    """The most adjacent true flags."""
    return max((len(list(same)) for flag, same in groupby(flags) if flag), default=0)


def judge(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """The figures of one text, in the order of SCHEMA after doc_id."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split on ASCII white space only
    n_words = len(words)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    repeated = repeat_words(words)
    failed = n_words < 20 or 100 * repeated > 30 * n_words
    ratio = len(data) / len(packer.compress(data)) if data else 0.0
    low, high = next((lo, hi) for start, lo, hi in reversed(bands.doc) if len(data) >= start)
    size = bands.chunk_bytes
    # The last chunk takes the remainder, so none is shorter than chunk_bytes.
    cuts = [data[i : i + size if i + 2 * size <= len(data) else None] for i in range(0, len(data) - size + 1, size)] if len(data) >= 2 * size else []
    off = [not bands.chunk[0] <= len(c) / len(packer.compress(c)) <= bands.chunk[1] for c in cuts]
    outside = sum(off)
    fits = low <= ratio <= high and outside <= bands.max_outside * len(cuts) and longest_run(off) <= bands.max_run
    fits = fits and (len(data) < bands.gain_bytes or ratio * entropy(data) >= 8 * bands.min_gain)
    return n_words, chars, symbols, dup_lines(data), repeated, failed, not failed and fits, len(data), ratio, len(cuts), outside


def quality(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the base counts, the compression ratio and the verdict.

    Null and empty texts have no words, a ratio of 0 and fail the base rule. Texts of
    any length are read whole. Repeated rows are each judged; an empty table gives no
    rows. Other columns of docs are not read, so their names can't clash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        for batch in chain.from_iterable(map(text_slices, batches)):
            rows = [(i, *judge(t, bands, packer)) for i, t in zip(batch["doc_id"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInPandas(run, SCHEMA)
