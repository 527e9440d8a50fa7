"""The registered queries of this subpackage: opN_<name>, with production parameters."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.llm import collocations, decontaminate, exact_topk, hard_negatives, langid, line_dedup, ngram_join, quality, sentencepiece_codec, token_counts, toxicity, url_filter, warc
from flightlens.llm.common import finished
from flightlens.session import table


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), Path(model).read_bytes())


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), Path(tokenizer).read_text())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return finished(lambda: toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: line_dedup.line_report(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def judged() -> DataFrame:
        found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
        return found.select(
            "doc_id",
            "n_words",
            "n_hit",
            "n_items",
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        )

    return finished(judged)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest_records(warc.derive(warc.responses(table(spark, sf_dir, "pages"))))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % hard_negatives.ANCHOR_EVERY == 0, label)


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % exact_topk.QUERY_EVERY == 0)


QUERIES = {
    "op1_compression_bands": op1_compression_bands,
    "op2_ngram_join": op2_ngram_join,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_topk": op13_exact_topk,
}

ORACLE_SQL = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_exact_topk": exact_topk.ORACLE,
}
