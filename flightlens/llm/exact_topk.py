"""Exact top-k by inner product: ball trees per shard, searched by branch and bound.

A node of a shard's tree is a ball; no row in it scores more than query . centre + |query| radius.
Nodes whose bound is under a query's kth score so far are left out with all below them, and leaves
are met in the order of their bounds, each query's best leaf first. The kth score is shared: a query
takes it from its home shard to all other shards, and within a task from shard to shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm import vector_blocks as vb
from flightlens.llm.common import discard, materialize

K = 5
QUERY_EVERY = 50
LEAF_ROWS = 128
#: Float bounds are widened by this share of their size, and by one.
SLACK = 1e-9

SCHEMA = "query_id long, rank int, vec_id long, score long"


def build_tree(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A ball tree as arrays: order of the rows, and by node centre, radius, first and last place, and children (-1: none).

    A node is cut in the middle along the line between two rows that lie far apart.
    """
    order = np.arange(len(vectors))
    centres, radii, first, last, left, right = [], [], [], [], [], []
    todo = [(0, len(vectors), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        node, rows = len(centres), vectors[order[a:b]]
        centre = rows.mean(0)
        distance = vb.norms(rows - centre)
        centres.append(centre)
        radii.append(distance.max())
        first.append(a)
        last.append(b)
        left.append(-1)
        right.append(-1)
        if parent >= 0:
            (left, right)[side][parent] = node
        if b - a > leaf_rows and radii[-1] > 0:
            far = rows[distance.argmax()]
            other = rows[vb.norms(rows - far).argmax()]
            order[a:b] = order[a:b][np.argsort(rows @ (far - other), kind="stable")]
            middle = (a + b) // 2
            todo += [(middle, b, node, 1), (a, middle, node, 0)]
    return {"order": order, "centres": np.stack(centres), "radii": np.array(radii), "first": np.array(first), "last": np.array(last), "left": np.array(left), "right": np.array(right)}


def index(vectors: np.ndarray, references: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    tree = build_tree(vectors)
    return tree | {"vectors": vectors[tree["order"]], "ids": ids[tree["order"]]}


def bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No row of a node scores more than this for a query."""
    length = vb.norms(queries)
    return queries @ centres.T + length[:, None] * radii + SLACK * length[:, None] * (vb.norms(centres) + radii) + 1


def shard_bound(block: dict[str, np.ndarray], shard: dict[str, np.ndarray]) -> float:
    return bounds(block["vectors"].astype(np.float64), shard["centres"][:1], shard["radii"][:1]).max()


def search(block: dict[str, np.ndarray], shard: dict[str, np.ndarray]) -> None:
    """Branch and bound of a block's queries in one shard; their best is kept in the block."""
    queries = block["vectors"].astype(np.float64)
    bound = bounds(queries, shard["centres"], shard["radii"])
    threshold = np.maximum(block["least"], block["best_score"][:, -1])
    alive = np.zeros(bound.shape, bool)
    alive[:, 0] = bound[:, 0] >= threshold
    for node, (a, b) in enumerate(zip(shard["left"], shard["right"], strict=True)):  # parents stand before their children
        if a >= 0:
            for child in (a, b):
                alive[:, child] = alive[:, node] & (bound[:, child] >= threshold)
    leaves = np.flatnonzero(shard["left"] < 0)
    bound = np.where(alive, bound, -np.inf)[:, leaves]

    def meet(leaf: int, rows: np.ndarray) -> None:
        a, b = shard["first"][leaves[leaf]], shard["last"][leaves[leaf]]
        found = vb.scores(queries[rows], shard["vectors"][a:b])
        r, c = np.nonzero((found >= threshold[rows, None]) & (shard["ids"][a:b] != block["ids"][rows, None]))
        vb.keep_best(block["best_score"], block["best_id"], rows[r], shard["ids"][a:b][c], found[r, c])
        threshold[rows] = np.maximum(threshold[rows], block["best_score"][rows, -1])

    best = bound.argmax(1)
    for leaf in np.unique(best):
        rows = np.flatnonzero((best == leaf) & (bound[:, leaf] >= threshold))
        if len(rows):
            meet(leaf, rows)
    bound[np.arange(len(best)), best] = -np.inf
    for leaf in np.argsort(-bound.max(0)):
        rows = np.flatnonzero((bound[:, leaf] > -np.inf) & (bound[:, leaf] >= threshold))
        if len(rows):
            meet(leaf, rows)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = vb.SHARD_ROWS, block_rows: int = vb.BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query (all, if fewer).

    Components count as floor(256 * x); ties go to the smaller vec_id. A query never meets rows of
    its own id. Null ids and vectors, and vectors with null or non-finite components, take no
    part; shorter vectors count as filled up with zeros; exact repeats of a row count once; rows
    of one id but different vectors are rows of their own, as queries too. Scores beyond 64 bits
    stop at the ends of the range. Without queries or rows there is no result. Other columns are
    not read, so their names can't clash.
    """
    layout = vb.lay_out(vectors, id_col, vec_col, None, is_query, index, lambda rows: vb.start(rows, k), shard_rows, block_rows)
    if layout is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    home = vb.at_home(layout, layout.blocks, search)
    found = materialize(vb.elsewhere(layout, home, search, k, shard_bound).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    discard(*layout.spent, home)
    return found


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
