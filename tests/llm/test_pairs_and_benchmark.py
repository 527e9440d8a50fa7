"""The n-gram join, decontamination and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flightlens.llm import decontaminate, line_dedup, ngram_join

DOC = "doc_id long, text string"


def sets_of(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_components(rows, k, percent):
    sets = [(i, sets_of(t, k)) for i, t in rows]
    least = {n: n for n in range(len(rows))}

    def find(n):
        while least[n] != n:
            n = least[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            (ia, sa), (ib, sb) = sets[a], sets[b]
            if ia is not None and ib is not None and sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                least[find(a)] = find(b)
    groups = {}
    for n, (i, _) in enumerate(rows):
        groups.setdefault(find(n), []).append(i)
    return [(i, len(sets[n][1]), i if i is None else min(groups[find(n)])) for n, (i, _) in enumerate(rows)]


def corpus(seed, sizes, copies, vocabulary=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    boiler = [rng.choice(vocab) for _ in range(12)]
    texts = []
    for size in sizes:
        base = [rng.choice(vocab) for _ in range(size)]
        if rng.random() < 0.5:
            base = boiler + base
        texts.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            other = list(base)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts.append(" ".join(other))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 85)])
def test_ngram_join_equals_brute_force(spark, words, percent):
    texts = corpus(words, [3, 5, 8, 12, 16, 20, 24, 30, 40, 80, 150] * 3, 6)
    rows = [(i, t) for i, t in enumerate(texts)] + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One"), (9005, "one"), (None, texts[0]), (9006, "é " * 30), (9007, "É " * 30)]
    rows += [(9010, texts[1]), (9010, texts[1])]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, DOC), words, percent).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(brute_components(rows, words, percent), key=key)


def test_a_large_group_of_near_copies_is_one_group_and_lists_stay_linear(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(300):
        other = list(base)
        for _ in range(2):
            other[rng.randrange(150)] = f"v{rng.randrange(5000)}"
        texts.append(" ".join(other))
    rows = list(enumerate(texts))
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert found == {i: c for i, _, c in brute_components(rows, 4, 85)}


def common_phrases(n=260):
    """Short texts whose every phrase stands in many others, so that lists are long; two in three have a near copy."""
    rng = random.Random(3)
    phrases = [" ".join(f"p{k}{j}" for j in range(5)) for k in range(7)]
    texts = [" ".join(rng.sample(phrases, 3)) for _ in range(n)]
    return [t + rng.choice(["", " tail", f" x{i}"]) for i, t in enumerate(texts)]


def test_small_sets_link_by_their_subsets(spark):
    rows = list(enumerate(common_phrases()))
    docs = spark.createDataFrame(rows, DOC)
    described = docs.mapInArrow(ngram_join._describe(4, 85, 24, spark.sparkContext.broadcast(ngram_join.ranked_shingles(docs, 4))), "doc_id long, n long, sig binary, toks array<long>")
    classes = described.groupBy("sig").agg(F.min("doc_id").alias("rid"), F.first("n").alias("n"), F.first("toks").alias("toks"))
    sets = {r.rid: set(r.toks) for r in classes.collect()}
    small = ngram_join.boundary(classes, 85)
    assert small >= max(map(len, sets.values()))
    posts = ngram_join._posts(classes, 85, small)
    assert posts.filter("pos >= 0 and n <= 0.85 * %d" % small).isEmpty()
    lists = {}
    for r in posts.filter("pos < 0").collect():
        lists.setdefault(r.key, set()).add(r.rid)
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked and linked == {(a, b) for rids in lists.values() for a in rids for b in rids if a < b}
    found = {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == {(i, c) for i, _, c in brute_components(rows, 4, 85)}


@pytest.mark.parametrize("small_max", [0, 3, 24])
def test_any_boundary_gives_the_same_groups(spark, small_max):
    rows = list(enumerate(common_phrases(120)))
    found = {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, DOC), small_max=small_max).collect()}
    assert found == {(i, c) for i, _, c in brute_components(rows, 4, 85)}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_registered_joins_enumerate_small_sets(spark, monkeypatch, words, percent):
    seen = []
    real = ngram_join.boundary
    monkeypatch.setattr(ngram_join, "boundary", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ngram_join.near_duplicates(docs, words, percent)
    assert seen and seen[0] > 0


@pytest.mark.parametrize("percent", [80, 85])
def test_prefixes_and_subsets_miss_no_pair(percent):
    for a in range(1, 30):
        for b in range(a, 40):
            for shared in range(a + 1):
                if 100 * shared >= percent * (a + b - shared):
                    assert shared >= ngram_join.least_overlap(a, b, percent)
                    assert a - shared < ngram_join.prefix_length(a, percent) and b - shared < ngram_join.prefix_length(b, percent)
                    assert ngram_join.least_overlap(a, b, percent) in set(ngram_join.overlaps(a, percent)) & set(ngram_join.overlaps(b, percent))


def test_ngram_join_of_an_empty_table_and_clashing_columns(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], DOC)).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "k"), (2, "a b c d e f", 6, "k")], "doc_id long, text string, rid long, key string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and [r.rid for r in kept.collect()] == [5]


def test_keep_one_keeps_rows_without_sets_and_one_of_repeats(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "a b c d e f g"), (4, "a b c d e f g"), (5, "x y z"), (5, "a b c d e f g")]
    kept = [tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, DOC)).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d e f g"), (2, None), (3, ""), (None, "a b c d e f g"), (5, "x y z"), (5, "a b c d e f g")], key=str)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, bench, window=13):
    wins = {}
    for item, text in bench:
        w = bench_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for i, text in rows:
        w = bench_words(text)
        hit, items = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    items |= wins[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), sorted(items)))
    return out


def bench_case(seed):
    rng = random.Random(seed)
    vocab = [f"b{i}" for i in range(60)] + ["É", "ß9", "x"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 7, 9, 13, 14, 30])))) for i in range(12)]
    bench += [(100, None), (101, "!!"), (102, bench[3][1])]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(1, 80))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words))
            words[at:at] = (rng.choice(bench[:12])[1]).split()
        rows.append((i, rng.choice([" ", "-", ", ", "\n"]).join(words).title() if rng.random() < 0.3 else " ".join(words)))
    return rows + [(200, None), (201, ""), (202, "..."), (None, rows[0][1]), (0, rows[1][1]), (203, rows[2][1]), (203, rows[2][1])], bench


@pytest.mark.parametrize("max_set", [100_000, 5])
def test_decontamination_equals_brute_force(spark, max_set):
    rows, bench = bench_case(3)
    found = decontaminate.find_hits(spark.createDataFrame(rows, DOC), spark.createDataFrame(bench, "item_id long, text string"), max_set=max_set).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in found), key=str) == sorted(brute_hits(rows, bench), key=str)
    assert all(len(r.hit_positions) == r.n_hit for r in found)


def test_decontamination_removes_documents_or_spans(spark):
    item = " ".join(f"q{i}" for i in range(13))
    rows = [(1, f"Start, {item.upper()}! The end."), (2, "clean text"), (3, None), (1, "other text of one")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], DOC + ", win string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    whole = decontaminate.decontaminate(docs, bench)
    assert whole.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in whole.collect()), key=str) == sorted([(2, "clean text"), (3, None), (1, "other text of one")], key=str)
    spans = decontaminate.decontaminate(docs, bench, remove="spans")
    assert sorted((tuple(r)[:2] for r in spans.collect()), key=str) == sorted([(1, "Start! The end."), (2, "clean text"), (3, None), (1, "other text of one")], key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == 4
    assert decontaminate.find_hits(spark.createDataFrame([], DOC), bench).count() == 0


def brute_lines(rows, sites=5, chars=20):
    seen = {}
    norm = lambda x: x.strip(" ").lower()
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if len(norm(line)) >= chars and site is not None:
                seen.setdefault(norm(line), set()).add(site)
    spread = {k for k, v in seen.items() if len(v) >= sites}
    out = []
    for i, text, site in rows:
        gone = [x for x in (text or "").split("\n") if norm(x) in spread]
        if gone:
            text = "\n".join(x for x in text.split("\n") if norm(x) not in spread)
        out.append((i, text, site))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    boiler = [f"Shared line number {i} of all the sites" for i in range(8)]
    rows = []
    for i in range(200):
        own = [f"line {i} {j} with words of its own {rng.random()}" for j in range(rng.randrange(1, 6))]
        own += [("  " if rng.random() < 0.3 else "") + rng.choice(boiler) for _ in range(rng.randrange(3))]
        rng.shuffle(own)
        rows.append((i, "\n".join(own), rng.choice(["s1", "s2", "s3", "s4", "s5", "s6", "s7", None, "hot", "hot", "hot"])))
    rows += [(500, None, "s1"), (501, "", "s2"), (502, boiler[0], "s3"), (0, rows[1][1], "s4"), (503, rows[2][1], "s9"), (503, rows[2][1], "s9"), (None, rows[3][1], "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as pos")
    found = line_dedup.dedup_lines(docs)
    assert found.columns == docs.columns
    assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == sorted(brute_lines(rows), key=str)
    assert any(t == "" for i, t, _ in brute_lines(rows) if i == 502)  # all boilerplate, and no copy of another
    report = {(r.doc_id, r.text_sha256) for r in line_dedup.line_report(docs).collect()}
    assert report == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in brute_lines(rows)}


def test_boilerplate_goes_whatever_its_share_and_copies_count_once(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    boiler, passage, body = say(15), say(60), [say(40) for _ in range(3)]
    own = [say(5) for _ in range(12)]
    rows = [(i, f"{boiler}\n{own[i]}", f"s{i}") for i in range(6)]  # boilerplate is most of them
    rows += [(i, f"{passage}\n{own[i]} {say(30)}", f"s{i}") for i in range(6, 12)]
    copies = ["\n".join([boiler, *body])] * 6 + ["\n".join([boiler, *body]).replace(w, "edited", 1) for w in rng.sample(" ".join(body).split(), 20)]
    rows += [(20 + i, t, f"s{i % 9}") for i, t in enumerate(copies)]
    rows += [(90, boiler, "s1"), (91, f"{boiler}\n{boiler}", "s2"), (92, None, "s3"), (93, "", "s4"), (None, f"{boiler}\n{own[0]}", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = corpus_pipeline.dedup_lines(spark, docs, "")
    assert found.columns == docs.columns
    want = [(i, t if t is None else "\n".join(x for x in t.split("\n") if x not in (boiler, passage)), s) for i, t, s in rows]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    assert want[0][1] == own[0] and all(t.count("\n") == 2 for i, t, _ in want if i and 20 <= i < 46)


@pytest.mark.parametrize("sites", [20, 300])
def test_sketched_lines_near_the_threshold_are_counted_exactly(spark, sites):
    rows = [(line, f"site {s}") for line in range(8) for s in range(sites - 4 + line)]
    lines = spark.createDataFrame([(line, line, site) for line, site in rows], "h1 long, h2 long, site string")
    assert {r.h1 for r in line_dedup.spread_lines(lines, sites, lg_k=8).collect()} == {4, 5, 6, 7}


def test_names_of_docs_never_clash_with_those_of_the_operators(spark):
    names = ["line_doc", "line_hash", "line_gone", "bad_id", "bad_hash", "bad_at", "gone", "_gone", "h1", "estimate"]
    docs = spark.createDataFrame([(i, f"Text {i} of one two three four five six\nThe shared line of all sites", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    docs = docs.selectExpr("*", *[f"doc_id as {n}" for n in names])
    bench = spark.createDataFrame([(1, "text 3 of one two")], "item_id long, text string")
    for found in (line_dedup.dedup_lines(docs), line_dedup.drop_boilerplate(docs), decontaminate.decontaminate(docs, bench), decontaminate.decontaminate(docs, bench, remove="spans"), ngram_join.keep_one(docs)):
        assert found.columns == docs.columns
        assert all(r[n] == r.doc_id for r in found.collect() for n in names)
    assert all("shared" not in r.text for r in line_dedup.dedup_lines(docs).collect())
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [0, 1, 2, 4, 5]


def test_line_dedup_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.line_report(empty).count() == 0
