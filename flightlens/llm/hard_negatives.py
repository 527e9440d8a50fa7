"""Hard negatives by angular triangle filtering.

Each row's angles to a few reference directions are stored. For two rows a and v and a reference r
the angle between a and v lies between |angle(a, r) - angle(v, r)| and angle(a, r) + angle(v, r), so
the cosine lies in an interval; times the norms it bounds the score. Rows are kept in windows of one
label that are sorted by angle, with the least and greatest angles and norms of the window; only
windows whose bounds meet the scores in question get integer scoring. Bounds are widened by more
than their rounding.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm import vector_blocks as vb
from flightlens.llm.common import discard, materialize

POSITIVES, NEGATIVES = 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
ANCHOR_EVERY = 50
WINDOW_ROWS = 128
#: The rounding of an arc cosine near one is about 1.5e-8; bounds are widened by this share of the norms' product, and by one.
SLACK = 1e-6

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def angles(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vb.unit(vectors) @ references.T, -1, 1))


def index(vectors: np.ndarray, references: np.ndarray, ids: np.ndarray, labels: np.ndarray, window_rows: int = WINDOW_ROWS) -> dict[str, np.ndarray]:
    """Rows sorted by label and angle, and the windows' angles to the references, norms and labels."""
    theta = angles(vectors, references)
    nearest = theta.min(0).argmin()
    order = np.lexsort((theta[:, nearest], labels))
    vectors, ids, labels, theta, length = vectors[order], ids[order], labels[order], theta[order], vb.norms(vectors[order])
    heads = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    cuts = np.concatenate([np.arange(a, b, window_rows) for a, b in zip(heads, np.r_[heads[1:], len(ids)], strict=True)])
    low, high = np.minimum.reduceat(theta, cuts), np.maximum.reduceat(theta, cuts)
    return {"vectors": vectors, "ids": ids, "cuts": np.r_[cuts, len(ids)], "window_label": labels[cuts], "low": low, "high": high, "short": np.minimum.reduceat(length, cuts), "long": np.maximum.reduceat(length, cuts), "references": references}


def score_bounds(anchors: np.ndarray, shard: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of anchors with the rows of each window."""
    theta, length = angles(anchors, shard["references"]), vb.norms(anchors)[:, None]
    near, far = np.zeros((2, len(anchors), len(shard["low"])))
    far += np.pi
    for r in range(theta.shape[1]):
        own, low, high = theta[:, r, None], shard["low"][:, r], shard["high"][:, r]
        near = np.maximum(near, np.maximum(own - high, low - own))
        far = np.minimum(far, np.minimum(own + high, 2 * np.pi - own - low))
    most, least = np.cos(near), np.cos(np.maximum(far, near))
    slack = SLACK * length * shard["long"] + 1
    upper = length * np.where(most > 0, shard["long"], shard["short"]) * most + slack
    lower = length * np.where(least > 0, shard["short"], shard["long"]) * least - slack
    return lower, upper


def shard_bound(block: dict[str, np.ndarray], shard: dict[str, np.ndarray]) -> float:
    return score_bounds(block["vectors"].astype(np.float64), shard)[1].max()


def search(block: dict[str, np.ndarray], shard: dict[str, np.ndarray], same: bool) -> None:
    """The best rows of a shard for each slot of a block's anchors.

    same: rows of the anchor's label, from the highest score on. Otherwise rows of other labels,
    whose scores lie between a slot's low and high.
    """
    anchors = block["vectors"].astype(np.float64)
    slots = len(block["best_score"]) // len(anchors)
    anchor_of = np.repeat(np.arange(len(anchors)), slots)
    high = block.get("high", np.full(len(anchor_of), vb.NO_ID))
    threshold = np.maximum(block["least"], block["best_score"][:, -1])
    lower, upper = score_bounds(anchors, shard)
    fits = (shard["window_label"] == block["labels"][:, None]) == same
    for w in np.argsort(-np.where(fits, upper, -np.inf).max(0)):
        asking = np.flatnonzero(fits[anchor_of, w] & (upper[anchor_of, w] >= threshold) & (lower[anchor_of, w] <= high) & (threshold <= high))
        if not len(asking):
            continue
        a, b = shard["cuts"][w : w + 2]
        rows, at = np.unique(anchor_of[asking], return_inverse=True)
        found, ids = vb.scores(anchors[rows], shard["vectors"][a:b])[at], shard["ids"][a:b]
        s, c = np.nonzero((found >= threshold[asking, None]) & (found <= high[asking, None]) & (ids != block["ids"][anchor_of[asking], None]))
        vb.keep_best(block["best_score"], block["best_id"], asking[s], ids[c], found[s, c])
        threshold[asking] = np.maximum(threshold[asking], block["best_score"][asking, -1])


def _bands(block: dict[str, np.ndarray], negatives: int, low_percent: int, high_percent: int) -> dict[str, np.ndarray]:
    """A state in which every positive of a block is a slot, with the scores its negatives may have."""
    held = block["slot_score"].ravel()
    whole = [int(p) for p in held]
    low = np.array([max(-(-low_percent * p // 100), vb.NONE + 1) for p in whole], np.int64)
    high = np.array([min(high_percent * p // 100, vb.NO_ID) if p > vb.NONE else vb.NONE for p in whole], np.int64)
    return vb.start(len(held), negatives, low) | {"high": high}


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = vb.SHARD_ROWS,
    block_rows: int = vb.BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the first rows of its label (higher integer inner products first,
    ties by smaller id); for each, the first rows of other labels whose score is between
    low_percent and high_percent of the positive's. Pairs with none give no row. Null ids, labels
    and vectors, and vectors with null or non-finite components, take no part; shorter vectors
    count as filled up with zeros; exact repeats of a row count once; rows of an anchor's own id
    are neither its positives nor its negatives. An empty table gives no rows. Other columns are
    not read, so their names can't clash.
    """
    layout = vb.lay_out(vectors, id_col, vec_col, label, is_anchor, index, lambda rows: vb.start(rows, positives), shard_rows, block_rows)
    if layout is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    alike, unlike = partial(search, same=True), partial(search, same=False)
    home = vb.at_home(layout, layout.blocks, alike)
    nearest = vb.elsewhere(layout, home, alike, positives, shard_bound)
    asked = vb.with_slots(layout.blocks, nearest, positives, partial(_bands, negatives=negatives, low_percent=low_percent, high_percent=high_percent))
    begun = vb.at_home(layout, asked, unlike)
    found = vb.elsewhere(layout, begun, unlike, negatives, shard_bound)
    found = materialize(
        found.select(
            F.col("query_id").alias("anchor_id"),
            F.col("slot_id").alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"),
            F.col("slot_score").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
    discard(*layout.spent, home, asked, begun)
    return found


ORACLE = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
