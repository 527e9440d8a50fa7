"""Collocations against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flightlens.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, rank string"


def brute(rows, min_count, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        found = []
        for p, a in candidates.items():
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * longer[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode("utf-8"), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "é", "ß#", "\U0001f600", "x\x00y", "日本", "a", "b", "city"]
    rows = [(None, "en"), ("", "en"), ("   \t ", "fr"), (None, None), ("!!..\n\r", "es")]
    for _ in range(docs):
        words = []
        for _ in range(rng.randrange(60)):
            words += ["new", "york", "city"] if rng.random() < 0.1 else [rng.choice(vocabulary)]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", ":", "\x1c "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows + rows[:20]


def collected(spark, rows, **options):
    docs = spark.createDataFrame([(i % 7, t, lang, i, "r") for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, collocations.phrases(docs, **options).collect()))


@pytest.mark.parametrize(("seed", "bits", "top"), [(1, 64, 2000), (2, 64, 5), (3, 9, 2000)])
def test_collocations_equal_brute_force(spark, seed, bits, top):
    rows = corpus(seed)
    found = collected(spark, rows, min_count=3, top=top, bits=bits)
    assert found == brute(rows, 3, top) and found


def test_an_empty_table_and_texts_without_words_give_no_collocations(spark):
    assert collected(spark, []) == []
    assert collected(spark, [(None, "en"), ("", None), (" .\n", "en")], min_count=1) == []


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta"]
    long = "".join(rng.choice(words) + rng.choice([" ", " ", ". "]) for _ in range(400_000))
    whole = "one two " * 200_000  # a piece that is longer than a slice
    rows = [(long, "en"), (whole, "en"), (whole + "." + long, "de")]
    assert collected(spark, rows, min_count=1000, top=50) == brute(rows, 1000, 50)


def test_parts_join_to_the_text_and_end_with_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 50)
    text = b"aaa bbb. " * 30 + b"c" * 130 + b"." + b"d" * 90
    parts = list(collocations._parts(text))
    assert b"".join(parts) == text and all(p[-1:] == b"." for p in parts[:-1]) and len(parts) > 4


def test_a_polynomial_gives_equal_ranges_equal_fingerprints_and_others_different_ones():
    polynomial = collocations.Polynomial(collocations._BASES[0])
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 2000).astype(np.uint8)
    prefixes = polynomial.prefixes(data)
    start = np.repeat(np.arange(1900), 8)
    end = start + np.tile(np.arange(1, 9), 1900)
    prints = polynomial.ranges(prefixes, start, end, np.uint64(7)).tolist()
    by_text = defaultdict(set)
    for s, e, p in zip(start.tolist(), end.tolist(), prints, strict=True):
        by_text[data[s:e].tobytes()].add(p)
    assert all(len(p) == 1 for p in by_text.values()) and len({min(p) for p in by_text.values()}) == len(by_text)
