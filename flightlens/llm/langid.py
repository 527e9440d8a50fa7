"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters are hashed into a fixed number of buckets. Document
frequencies are counted over all training documents; the weights are learned by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of each
language, and a temperature is fitted on documents of that sample that the weights have
not seen. Samples leave the tasks as n-gram counts, not as texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import held_out, mix64, text_slices

BUCKETS = 1 << 14
#: Training documents that the weights are learned from, about so many over all languages.
SAMPLE_ROWS = 4_000
#: Of each language at least about so many, or all there are.
LANG_ROWS = 200
#: Counts of the sample in all, at 6 bytes each; with fewer documents where these are long.
SAMPLE_COUNTS = 8_000_000
CALIBRATION_SHARE = 0.2
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1e-4
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def ngram_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a lower-cased text; white space counts as one space."""
    points = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts = []
    with np.errstate(over="ignore"):
        code = np.full(len(points), 1, np.uint64)
        for n in range(3):
            code = code[: len(points) - n] * np.uint64(0x110001) + points[n:]
            parts.append(mix64(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)))
    found = np.bincount((np.concatenate(parts) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(found)
    return at, found[at]


@dataclass
class Model:
    """Weights by bucket and language, bias, inverse document frequencies and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sublinear tf times idf, of unit length."""
        return self.weighted(*ngram_counts(text, len(self.idf)))

    def weighted(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of n-gram counts."""
        values = (1 + np.log(n)) * self.idf[at]
        return at, values / max(float(np.sqrt((values * values).sum())), 1e-12)

    def logits(self, text: str) -> np.ndarray:
        at, values = self.features(text)
        return values @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; und and 0 without letters."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, seed: int = 7) -> None:
    """FTRL-proximal with per-coordinate rates, one document (its features) at a time."""
    dims, k = len(model.idf) + 1, len(model.langs)
    z, n = np.zeros((dims, k)), np.zeros((dims, k))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, dims - 1), np.append(x, 1.0)  # the last row is the bias
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            g = softmax(x @ w)
            g[classes[i]] -= 1.0
            step = np.outer(x, g)
            square = step * step
            z[at] = zi + step - (np.sqrt(ni + square) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + square
    w = _weights(z, n)
    model.weights, model.bias = w[:-1], w[-1]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit_temperature(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray) -> float:
    """The temperature of least log loss on documents (their features) the weights have not seen."""
    if not len(rows):
        return 1.0
    logits = np.array([x @ model.weights[at] + model.bias for at, x in rows])

    def loss(t: float) -> float:
        scaled = logits / t
        scaled -= scaled.max(1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(1)) - scaled[np.arange(len(classes)), classes]).mean())

    return float(min(np.geomspace(0.2, 5.0, 40), key=loss))


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, dict[str, int]]:
    """In how many documents (text, lang) each bucket is, and the documents of each language: sums by task, then over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, langs = np.zeros(buckets, np.int64), Counter()
        for batch in batches:
            langs.update(batch["lang"])
            for text in batch["text"]:
                df[ngram_counts(text, buckets)[0]] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": [*at, *[-1] * len(langs)], "lang": pd.Series([*[""] * len(at), *langs], dtype=object), "n": [*df[at], *langs.values()]})

    rows = docs.select("text", "lang").mapInPandas(run, "bucket long, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(buckets, np.int64)
    for r in rows:  # one for each bucket and each language
        if r.bucket >= 0:
            df[r.bucket] = r.n
    return df, {r.lang: r.n for r in rows if r.bucket < 0}


def sampled_counts(docs: DataFrame, totals: dict[str, int], rows: int, buckets: int = BUCKETS) -> list:
    """(lang, at, n) of a sample of each language, as bytes, in an order drawn by a hash of id and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [ngram_counts(t, buckets) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"].astype(object), "draw": batch["draw"], "at": [a.astype("<u2").tobytes() for a, _ in counts], "n": [n.astype("<i4").tobytes() for _, n in counts]})

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, int(min(1.0, rows / n) * (1 << 30)))])
    drawn = docs.withColumn("draw", draw).filter(F.col("draw") < limit[F.col("lang")]).select("text", "lang", "draw")
    return drawn.mapInPandas(run, "lang string, draw long, at binary, n binary").orderBy("draw", "lang", "at", "n").limit(2 * rows * len(totals)).collect()


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, lang_rows: int = LANG_ROWS, sample_counts: int = SAMPLE_COUNTS
) -> Model:
    """A model from the documents with a text and a language that are not held out.

    Weights are learned from a bounded sample: of each language an equal part of
    sample_rows documents, but at least lang_rows (or all there are), drawn by a hash of id
    and text; fewer, in proportion, where their n-gram counts would be more than
    sample_counts in all. Whole texts are read. So every language with a label is learned,
    however rare. Frequencies of n-grams and languages are those of all documents. Without
    training documents the model knows no language and predicts und.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    df, totals = document_frequencies(rows)
    total = sum(totals.values())
    idf = np.log((1 + total) / (1 + df)) + 1.0
    langs = sorted(totals)
    model = Model(langs, idf, np.zeros((len(idf), len(langs))), np.zeros(len(langs)))
    if not langs:
        return model
    each = max(sample_rows / len(langs), lang_rows)
    each = max(1, int(each * min(1.0, sample_counts / (each * len(langs) * df.sum() / total + 1))))
    sample = sampled_counts(rows, totals, each)
    classes = np.array([langs.index(r.lang) for r in sample])
    cut = max(1, int(len(sample) * (1 - CALIBRATION_SHARE)))
    features = [model.weighted(np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.n, "<i4")) for r in sample]
    fit_ftrl(model, features[:cut], classes[:cut])
    model.temperature = fit_temperature(model, features[cut:], classes[cut:])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the language's calibrated probability).

    Null texts and texts without letters give und and 0. Whole texts are read; repeated
    rows are each predicted; an empty table gives no rows. Other columns are not read, so
    their names can't clash. Ties go to the language first in sorted order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages doubles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in chain.from_iterable(map(text_slices, batches)):
            found = [own.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
