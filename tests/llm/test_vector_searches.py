"""Exact top-k and hard negatives against brute force over whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlens.llm import exact_topk, hard_negatives
from flightlens.llm import vector_blocks as vb

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(None, [1.0, 2.0], 1), (50, None, 1), (100, [1.0, None], 1), (150, [nan, 1.0], 2), (200, [1.0, inf], 2), (7, [0.5], None), (250, [], 3), (14, [0.0] * 4, 1), (300, [0.0] * 4, 1), (300, [0.0] * 4, 1), (350, [2.0], 1), (351, [2.0, 0.0], 2)]


def table(seed, n, dim, labels=3, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        kind = rng.random()
        v = centres[0] if kind < 0.3 else centres[rng.integers(4)] + 0.1 * rng.normal(size=dim) if kind < 0.6 else rng.normal(size=dim)
        rows.append((i, [float(x) for x in scale * v], int(rng.integers(labels)) if rng.random() < 0.95 else None))
    return rows + rows[: n // 10]


def whole(rows, labelled):
    found = set()
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and not (labelled and label is None):
            ints = [math.floor(256 * x) for x in v]
            while ints and ints[-1] == 0:
                ints.pop()
            found.add((i, tuple(ints), label if labelled else 0))
    return sorted(found, key=lambda r: (r[0], r[1], r[2]))


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, every, k):
    held = whole(rows, False)
    out = []
    for q, v, _ in held:
        if q % every == 0:
            found = sorted((-product(v, w), i) for i, w, _ in held if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def brute_negatives(rows, every):
    held = whole(rows, True)
    out = []
    for a, v, label in held:
        if a % every == 0:
            scored = sorted((-product(v, w), i, other) for i, w, other in held if i != a)
            for s, p, _ in [r for r in scored if r[2] == label][:5]:
                fit = [(n, t) for t, n, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
                out += [(a, p, n + 1, i, -s, -t) for n, (i, t) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "dim", "scale", "shard_rows", "block_rows"), [(400, 8, 1.0, 40, 4), (150, 3, 1e5, 1000, 256), (60, 2, 1e6, 20, 5), (0, 1, 1.0, 10, 10)])
def test_top_k_equals_brute_force(spark, n, dim, scale, shard_rows, block_rows):
    rows = odd_rows() + table(n, n, dim, scale=scale)
    found = exact_topk.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, shard_rows=shard_rows, block_rows=block_rows)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 10, 5)


@pytest.mark.parametrize(("n", "dim", "scale", "shard_rows", "block_rows"), [(400, 6, 1.0, 40, 4), (150, 3, 40.0, 1000, 256), (80, 2, 1e5, 20, 5)])
def test_hard_negatives_equal_brute_force(spark, n, dim, scale, shard_rows, block_rows):
    rows = odd_rows() + table(n + 1, n, dim, scale=scale)
    found = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), shard_rows=shard_rows, block_rows=block_rows)
    want = brute_negatives(rows, 10)
    assert sorted(map(tuple, found.collect())) == want and want


def test_without_rows_or_queries_there_is_no_result(spark):
    for rows in ([], [(1, [1.0, 2.0], 1), (2, [3.0, 1.0], 2)], [(None, [1.0], 1), (10, None, 1)]):
        assert exact_topk.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0).collect() == []
        assert hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label")).collect() == []
    alone = exact_topk.top_k(frame(spark, [(10, [1.0], 1)]), F.col("vec_id") % 10 == 0)
    assert alone.collect() == []


def test_node_and_window_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16)) * 300
    vectors = np.floor(centres[rng.integers(12, size=3000)] + rng.normal(size=(3000, 16)) * 15)
    ids, labels = np.arange(3000), rng.integers(4, size=3000)
    references = vb.fit_references(vectors[:500])
    queries = vectors[::100]
    exact = queries @ vectors.T

    tree = exact_topk.build_tree(vectors)
    upper = exact_topk.bounds(queries, tree["centres"], tree["radii"])
    for node, (a, b) in enumerate(zip(tree["first"], tree["last"], strict=True)):
        assert (exact[:, tree["order"][a:b]].max(1) <= upper[:, node]).all()
    leaves = tree["left"] < 0
    assert sorted(np.concatenate([tree["order"][a:b] for a, b in zip(tree["first"][leaves], tree["last"][leaves], strict=True)])) == ids.tolist()
    fifth = np.sort(exact, 1)[:, -6]
    assert (upper[:, leaves] >= fifth[:, None]).mean() < 0.3

    shard = hard_negatives.index(vectors, references, ids, labels)
    low, high = hard_negatives.score_bounds(queries, shard)
    exact = queries @ shard["vectors"].T
    for w, (a, b) in enumerate(zip(shard["cuts"], shard["cuts"][1:], strict=False)):
        assert (low[:, w] <= exact[:, a:b].min(1)).all() and (exact[:, a:b].max(1) <= high[:, w]).all()
        assert len(set(labels[shard["ids"][a:b]])) == 1
    assert (high >= fifth[:, None]).mean() < 0.5


def test_scores_are_exact_beyond_doubles_and_stop_at_the_ends_of_the_range():
    big = np.array([[2.0**40 + 1, 3.0]])
    assert vb.scores(big, np.array([[2.0**20 + 1, 1.0]])).tolist() == [[(2**40 + 1) * (2**20 + 1) + 3]]
    assert vb.scores(big, big * 2.0**30).tolist() == [[vb.NO_ID]]
