"""The pipeline against a plain version of its stages, on documents with planted cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from flightlens.llm import queries, toxicity
from tests.llm.test_pairs_and_benchmark import brute_components, brute_hits, brute_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=11):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    boiler, bench = "Subscribe to our weekly letter today", [(i, say(30)) for i in range(5)]
    texts, toxic = [], {}
    for i in range(160):
        body = [say(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4))]
        if i % 4 == 0:
            body.insert(1, boiler)
        if i % 9 == 0:
            body.append(" ".join(rng.choice(["you are an idiot", "what a moron", "scum like you"]) for _ in range(3)))
            toxic[len(texts)] = 1
        if i % 13 == 0:
            body.append(bench[i % 5][1])
        texts.append("\n".join(body))
        if i % 10 == 0:  # a copy and a near copy
            texts += [texts[-1], texts[-1].replace("word1 ", "word2 ", 1)]
            if i % 9 == 0:
                toxic |= {len(texts) - 1: 1, len(texts) - 2: 1}
    texts += [None, "", "short", " \n "]
    rows = [(i, t, "en", f"site{rng.randrange(8)}", len(t or "")) for i, t in enumerate(texts)]
    return rows, [(i, 1, toxic.get(i, 0)) for i in range(len(texts))], bench


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows, labels, bench = planted()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, labels, bench


def test_pipeline_equals_its_plain_version(spark, tables):
    folder, rows, labels, bench = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "sentencepiece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scorer = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [(i, t, s) for i, t, _, s, _ in rows if scorer.score(t) < toxicity.THRESHOLD]
    bad = {i for i, _, x in labels if x}
    assert {i for i, _, _, _, _ in rows} - {i for i, _, _ in kept} == bad
    kept = [(i, t) for i, t, _ in brute_lines(kept)]
    assert not any("Subscribe" in (t or "") for _, t in kept)
    heads = {i for i, _, c in brute_components(kept, 5, 80) if i == c}
    kept = [(i, t) for i, t in kept if i in heads]
    hits = {i: 0 < h and 20 * h >= n for i, n, h, _ in brute_hits(kept, bench)}
    assert any(hits.values())
    kept = [(i, t) for i, t in kept if not hits[i]]
    known = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()) for i, ids in ((i, known.encode(t or "")) for i, t in kept))
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in found) == want
    assert all(r.parity for r in found)


def test_stages_keep_the_columns_of_documents(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(12)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_take_an_empty_table(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_every_operator_has_its_query():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
