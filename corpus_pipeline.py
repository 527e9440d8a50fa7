"""The corpus pipeline: stages over documents, each written and read again for the next."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flightlens.llm import decontaminate, line_dedup, ngram_join, sentencepiece_codec, toxicity
from flightlens.llm.common import discard, finished
from flightlens.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject; null and empty texts stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are spread over sites and distinct texts; null and empty texts stay as they are."""
    return line_dedup.drop_boilerplate(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more; texts without words and null ids stay."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark; those without words stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    """The documents' tokens, by count and digest, one row a document; of its columns only doc_id stays. Null texts have no tokens."""
    return sentencepiece_codec.digest(docs, Path(model).read_bytes())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", keep_one),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]
#: Learned scores and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, in order; of what they wrote only the last one's result is left."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return docs
