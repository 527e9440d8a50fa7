"""Size-aware heavy-light Jaccard join over word n-grams, and the groups its links form.

Texts become sets of hashed word shingles. Equal sets are one class from the start, so
copies never meet each other in a join. Between classes:

* small sets enumerate, for every overlap c that a partner of their size range would
  need, all their subsets of c shingles; two small sets that reach the overlap share one;
* large sets scan inverted lists: each set stands in the lists of its rarest shingles,
  as many as a partner must share at least one of;
* the boundary between small and large is the size up to which enumerating costs no more
  than scanning, by the table's own sizes, lists, and pairs that the lists open.

Either way a candidate counts only after an exact comparison of the whole sets. Shingles
frequent anywhere in the corpus stand last in the order, so lists stay short.

Only groups are asked for, so a list with many members is not compared pair by pair:
a few hubs are compared with all members, members already joined need no comparison,
and what stays apart after two rounds is compared in full: pair by pair in short lists,
inside blocks that only hand on links in long ones.

Shingles are told apart by 56 bits of a hash: within two sets of 1,000 shingles two
different ones fall together with a probability under 1e-10. Classes have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import discard, materialize, mix64, new_names, release_memory

#: Largest set size for which enumeration is considered, and whole sets are kept beside the lists.
SMALL_MAX = 24
#: Rows that a pair opened by a list costs, beside four for each shingle of its two sets: it
#: is told apart from other pairs, meets both classes and both whole sets, and is closed.
PAIR_ROWS = 6
#: Shingles seen at least so often in one batch count towards the corpus frequency.
BATCH_REPEATS = 2
#: So many frequent shingles are ranked (8 + 1 bytes each); the others keep hash order.
RANKED_MAX = 400_000
RANKED_MIN = 4
HUBS = 6
ROUNDS = 2
#: Lists of a set by which the first one shared with another set is told.
FIRST_KEYS = 64
#: Lists of so many members are compared in blocks of about so many shingles.
DENSE = 64
BLOCK_SHINGLES = 300_000
CHUNK_BYTES = 8 << 20
#: Nodes that a task joins at once.
STAR_NODES = 300_000


# ---------------------------------------------------------------- sets of shingles


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_hashes(texts: list[str | None], words: int, known: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of the texts, and the offsets at which each text's begin."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    if len(known) > 250_000:
        known.clear()
    lengths = np.array([len(s) for s in split], np.int64)
    flat = np.fromiter((known[w] for s in split for w in s), np.uint64, int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    hashes = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            moved = flat[j:]
            hashes[: len(moved)] = mix64(hashes[: len(moved)] * np.uint64(0x9E3779B97F4A7C15) + moved + np.uint64(j + 1))
    counts = np.where(lengths >= words, lengths - words + 1, np.minimum(lengths, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    inside = np.repeat(starts[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    found = hashes[inside] if len(inside) else hashes[:0]
    for i in np.flatnonzero((lengths > 0) & (lengths < words)):  # the whole sequence as one
        found[offsets[i]] = xxhash.xxh64_intdigest(b" ".join(split[i]), seed=int(lengths[i]))
    return found, offsets


def _chunks(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_BYTES of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0))
    if not len(sizes):
        return
    part = np.cumsum(sizes) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _count_repeats(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for chunk in _chunks(batch, 0):
                hashes, offsets = shingle_hashes(chunk.column(0).to_pylist(), words, known)
                own = [np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
                values, n = np.unique(np.concatenate(own), return_counts=True) if own else (hashes, hashes)
                often = n >= BATCH_REPEATS
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])
        release_memory()

    return run


def ranked_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the corpus and their levels, by hash; at most RANKED_MAX."""
    top = (
        docs.select("text")
        .mapInArrow(_count_repeats(words), "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= RANKED_MIN)
        .orderBy(F.desc("n"), "token")
        .limit(RANKED_MAX)
        .collect()
    )
    tokens = np.array([r.token for r in top], np.int64).view(np.uint64)
    levels = np.minimum(1 + np.floor(4 * np.log2(np.maximum([r.n for r in top], 1))), 127).astype(np.uint64) if top else tokens
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def ordered_sets(texts: list[str | None], words: int, ranked: tuple[np.ndarray, np.ndarray], known: _WordHashes) -> list[np.ndarray]:
    """Each text's set as ascending longs: rank level in the high bits, 56 hash bits below."""
    hashes, offsets = shingle_hashes(texts, words, known)
    values = hashes >> np.uint64(8)
    frequent, levels = ranked
    if len(frequent) and len(hashes):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        values |= np.where(frequent[at] == hashes, levels[at], np.uint64(0)) << np.uint64(56)
    values = values.astype(np.int64)
    return [np.unique(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]


def least_overlap(a: int, b: int, percent: int) -> int:
    """Shingles that sets of a and b must share to link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """So many of the first shingles that any partner shares one of them."""
    return n - -(-percent * n // 100) + 1 if n else 0


def overlaps(n: int, percent: int) -> list[int]:
    """Every overlap that a set of n may need with some partner, at most n."""
    sizes = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({c for c in (least_overlap(n, b, percent) for b in sizes) if 0 < c <= n})


def _describe(words: int, percent: int, small_max: int, ranked):
    """(doc_id, text) to (doc_id, n, sig, toks): whole sets up to small_max, else their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        table = ranked.value
        for batch in batches:
            for chunk in _chunks(batch, 1):
                sets = ordered_sets(chunk.column(1).to_pylist(), words, table, known)
                firsts = [s[: prefix_length(len(s), percent)] for s in sets]
                kept = [s if len(s) <= small_max else f for s, f in zip(sets, firsts, strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())),
                    ],
                    ["doc_id", "n", "sig", "toks"],
                )
        release_memory()

    return run


def _whole_sets(words: int, ranked):
    """(rid, sig, text) to (rid, whole): whole sets of those texts whose signature is sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        table = ranked.value
        for batch in batches:
            for chunk in _chunks(batch, 2):
                sets = ordered_sets(chunk.column(2).to_pylist(), words, table, known)
                rows = [(r, s) for r, g, s in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), sets, strict=True) if xxhash.xxh3_128_digest(s.tobytes()) == g]
                ends = np.concatenate([[0], np.cumsum([len(s) for _, s in rows])]).astype(np.int32)
                flat = np.concatenate([s for _, s in rows]) if rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))],
                    ["rid", "whole"],
                )

    return run


# ---------------------------------------------------------------- small sets: subsets


def subset_keys(tokens: np.ndarray, percent: int) -> list[int]:
    """One negative key for each subset of each overlap that the set may need."""
    keys = []
    for c in overlaps(len(tokens), percent):
        marks = mix64(tokens.view(np.uint64) ^ mix64(np.array([c], np.uint64)))
        values = [int(m) for m in marks]
        total = sum(values)
        sums = np.array([(total - sum(left)) % (1 << 64) for left in combinations(values, len(tokens) - c)], np.uint64)
        keys.append((mix64(sums) | np.uint64(1 << 63)).view(np.int64))
    return np.concatenate(keys).tolist() if keys else []


def _enumerate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [subset_keys(np.array(t, np.int64), percent) for t in batch.column(2).to_pylist()]
            times = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for k in keys for x in k], pa.int64()),
                    pa.array(np.repeat(np.asarray(batch.column(0)), times), pa.int64()),
                    pa.array(np.repeat(np.asarray(batch.column(1)), times), pa.int64()),
                    pa.array(np.full(sum(times), -1), pa.int64()),
                ],
                ["key", "rid", "n", "pos"],
            )

    return run


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(key, rid, n, pos) of each class in the lists of its first shingles."""
    length = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    rows = classes.select("rid", "n", F.posexplode(F.slice("toks", F.lit(1), length.cast("int"))).alias("pos", "key"))
    return rows.select("key", "rid", "n", F.col("pos").cast("long"))


def boundary(classes: DataFrame, percent: int, small_max: int = SMALL_MAX) -> int:
    """The largest size to enumerate: where enumerating small sets and scanning the lists of the others cost least.

    Enumerating costs one row for each subset. Scanning costs one row for each list of a set,
    and, for each partner of fitting size that the list opens, the work on a pair. Both are
    summed by size from the table's own sets and lists; equal costs go to enumeration. Sets
    that may have a partner beyond the boundary are in the lists as well.
    """
    sizes = {r.n: r.c for r in classes.filter(F.col("n") <= small_max).groupBy("n").agg(F.count("*").alias("c")).collect()}
    most = 100 * small_max // percent
    lists = _prefixes(classes.filter(F.col("n") <= most), percent).groupBy("key", "n").agg(F.count("*").alias("c"))
    # A list's counts by size: at most `most` of them, however long the list.
    lists = lists.groupBy("key").agg(F.collect_list(F.struct("n", "c")).alias("all")).select("all", F.explode("all").alias("own"))
    fitting = F.filter("all", lambda x: 100 * F.least(x["n"], F.col("own.n")) >= percent * F.greatest(x["n"], F.col("own.n")))
    opened = F.col("own.c") * (F.aggregate(fitting, F.lit(0).cast("long"), lambda s, x: s + x["c"]) - 1) / 2
    scans = {r.n: (r.c, r.p) for r in lists.groupBy("own.n").agg(F.sum("own.c").alias("c"), F.sum(opened).alias("p")).collect()}

    def cost(b: int) -> float:
        enumerated = sum(c * sum(comb(n, k) for k in overlaps(n, percent)) for n, c in sizes.items() if n <= b)
        return enumerated + sum(c + p * (PAIR_ROWS + 4 * n) for n, (c, p) in scans.items() if n > b or 100 * n >= percent * (b + 1))

    return min(range(small_max + 1), key=lambda b: (cost(b), -b))


# ---------------------------------------------------------------- links


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes, and the shingles left from the shared one on, still allow a link."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    left = (100 + percent) * F.least(na - pa_, nb - pb) >= percent * (na + nb)
    return sizes & ((pa_ < 0) | left)


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a.rid", "b.rid").alias("x"), F.greatest("a.rid", "b.rid").alias("y")).distinct()


def _hub_pairs(posts: DataFrame, seeds: range, percent: int) -> tuple[DataFrame, DataFrame]:
    """Each member of a list with the list's hubs, and the hubs: of any seed the member of least hash."""
    member = F.struct("rid", "n", "pos", "comp")
    least = [F.min_by(member, F.xxhash64("rid", F.lit(s))).alias(f"h{s}") for s in seeds]
    hubs = posts.groupBy("key").agg(*least).select("key", F.explode(F.array_distinct(F.array(*[f"h{s}" for s in seeds]))).alias("h")).select("key", "h.*")
    # A table of its own, so that Spark can split a list that many sets stand in.
    hubs = materialize(hubs)
    pairs = _pairs(
        posts.alias("a").join(
            hubs.alias("b"),
            (F.col("a.key") == F.col("b.key")) & (F.col("a.rid") != F.col("b.rid")) & (F.col("a.comp") != F.col("b.comp")) & _possible("a", "b", percent),
        )
    )
    return pairs, hubs


def _all_pairs(posts: DataFrame, percent: int, small: int) -> tuple[DataFrame, DataFrame]:
    """Members of a list in different groups, and the lists that they are read from. Two small sets meet in their subsets' lists alone.

    A pair is made in the first list that both stand in, not in each; that is seen from the
    first FIRST_KEYS lists of each. Pairs that meet only behind those are made in each.
    """
    firsts = posts.groupBy("rid").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST_KEYS).alias("firsts"))
    posts = materialize(posts.join(firsts, "rid"))
    covered = (F.col("a.pos") >= 0) & (F.greatest("a.n", "b.n") <= small)
    shared = F.array_min(F.array_intersect("a.firsts", "b.firsts"))
    first = F.coalesce(F.col("a.key") <= shared, F.lit(True))
    pairs = _pairs(
        posts.alias("a").join(
            posts.alias("b"),
            (F.col("a.key") == F.col("b.key")) & (F.col("a.rid") < F.col("b.rid")) & (F.col("a.comp") != F.col("b.comp")) & _possible("a", "b", percent) & ~covered & first,
        )
    )
    return pairs, posts


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that can still link once their stored first shingles are compared.

    Up to the lesser of the two last stored shingles both sets are known, so the overlap is
    at most what they share there plus the rest of the set with less left.
    """
    one = classes.select(F.col("rid").alias("x"), F.col("n").alias("nx"), F.col("toks").alias("tx"))
    two = classes.select(F.col("rid").alias("y"), F.col("n").alias("ny"), F.col("toks").alias("ty"))
    both = pairs.join(one, "x").join(two, "y").withColumn("cut", F.least(F.element_at("tx", -1), F.element_at("ty", -1)))
    left = F.least(F.col("nx") - _up_to("tx"), F.col("ny") - _up_to("ty"))
    most = F.size(F.array_intersect("tx", "ty")) + left
    return both.filter((100 + percent) * most >= percent * (F.col("nx") + F.col("ny"))).select("x", "y")


def _up_to(tokens: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t <= F.col("cut")))


def _sets(rids: DataFrame, classes: DataFrame, docs: DataFrame, to_sets) -> DataFrame:
    """(rid, whole): the whole sets of these classes, from the text of one document of each."""
    texts = classes.select("rid", "sig", "head").join(rids, "rid", "left_semi").join(docs, F.col("head") == F.col("doc_id")).select("rid", "sig", "text")
    return materialize(texts.mapInArrow(to_sets, "rid long, whole array<long>").dropDuplicates(["rid"]))


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, to_sets, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs whose whole sets link, and the sets that they are read from. Only the texts of these pairs are read again."""
    sets = _sets(pairs.select(F.col("x").alias("rid")).union(pairs.select("y")).distinct(), classes, docs, to_sets)
    one, two = sets.select(F.col("rid").alias("x"), F.col("whole").alias("wx")), sets.select(F.col("rid").alias("y"), F.col("whole").alias("wy"))
    same = F.size(F.array_intersect("wx", "wy"))
    links = pairs.join(one, "x").join(two, "y").filter((100 + percent) * same >= percent * (F.size("wx") + F.size("wy"))).select("x", "y")
    return links, sets


def block_links(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the rows of the two sides of a block that are in different groups, one for each row and group."""
    left, right = block[block["side"] == 0], block[block["side"] == 1]
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        tokens, at = np.unique(np.concatenate(right["whole"].to_numpy()), return_inverse=True)
        sizes = right["whole"].map(len).to_numpy()
        starts = np.cumsum(sizes) - sizes
        rids, comps, mark = right["rid"].to_numpy(), right["comp"].to_numpy(), np.zeros(len(tokens), np.int32)
        for rid, comp, whole in zip(left["rid"], left["comp"], left["whole"], strict=True):
            place = np.minimum(np.searchsorted(tokens, whole), len(tokens) - 1)
            place = place[tokens[place] == whole]
            mark[place] = 1
            shared = np.add.reduceat(mark[at], starts)
            mark[place] = 0
            hit = np.flatnonzero(((100 + percent) * shared >= percent * (len(whole) + sizes)) & (comps != comp))
            found += [(rid, rids[i]) for i in hit[np.unique(comps[hit], return_index=True)[1]]]
    return pd.DataFrame(found, columns=["x", "y"], dtype="int64")


def _dense_links(posts: DataFrame, classes: DataFrame, docs: DataFrame, to_sets, percent: int) -> DataFrame:
    """Links between different groups of long lists, found inside blocks, so that no pair becomes a row.

    Lists with the same hub are taken together, so near copies that share many lists meet
    once or a few times. Of such a collection all but the largest group meet everything;
    both sides are dealt over blocks of bounded size.
    """
    hubs = posts.groupBy("key").agg(F.min_by("rid", F.xxhash64("rid", F.lit(0))).alias("hub"))
    rows = met_rows = materialize(posts.join(hubs, "key").select("hub", "rid", "n", "comp").distinct())
    groups = rows.groupBy("hub", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    shape = groups.groupBy("hub").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.sum("t").alias("all"), F.max(F.struct("c", "comp", "t")).alias("m"))
    shape = shape.select("hub", "major", F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("nj"), F.ceil((F.col("all") - F.col("m.t")) / BLOCK_SHINGLES).cast("int").alias("ni"))
    rows = rows.join(shape.filter("ni > 0"), "hub")
    place, upto = F.xxhash64("rid", F.lit(1)), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = rows.filter("comp <> major").select("hub", "rid", "comp", F.lit(0).alias("side"), F.pmod(place, F.col("ni")).cast("int").alias("i"), upto("nj").alias("j"))
    every = rows.select("hub", "rid", "comp", F.lit(1).alias("side"), upto("ni").alias("i"), F.pmod(place, F.col("nj")).cast("int").alias("j"))
    sets = _sets(rows.select("rid").distinct(), classes, docs, to_sets)
    met = minor.unionByName(every).join(sets, "rid").groupBy("hub", "i", "j")
    links = met.applyInPandas(lambda block: block_links(block, percent), "x long, y long").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    links = materialize(links.distinct())
    discard(met_rows, sets)
    return links


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to edges that connect the same nodes: each with the least that it is connected with among the rows of a task."""
    over: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := over.setdefault(x, x)) != x:
            over[x] = x = over[up]
        return x

    def found() -> pa.RecordBatch:
        edges = [(x, root(x)) for x in over if over[x] != x]
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], ["u", "v"])

    last = None
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(over) > STAR_NODES and u != last:  # rows of a node that follow each other stay together
                yield found()
                over.clear()
            last, a, b = u, root(u), root(v)
            if a != b:
                over[max(a, b)] = min(a, b)
    yield found()
    release_memory()


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rid, comp) of every rid in links (x, y) and in known, an earlier result: comp is the least rid reachable.

    Each round has two star steps: every node hands its larger neighbours to the least one,
    then its smaller ones. The first is one join on node ids; for the second, rows that a
    task or a node has together are joined at once (_stars), so a node sends each task's
    rows as one. The number of rounds grows with the logarithm of the longest path; they end
    when every node is the least of its neighbours or has one neighbour alone. If links has
    nothing to add, known is returned.
    """
    stars = lambda edges: edges.mapInArrow(_stars, "u long, v long")
    edges = first = materialize(stars(links.filter("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"))))
    if known is not None:
        if first.isEmpty():
            discard(first)
            return known
        edges = edges.union(known.filter("rid <> comp").select(F.col("rid").alias("u"), F.col("comp").alias("v")))
    spent = [first]
    while True:
        edges = materialize(stars(stars(edges).repartition("u").sortWithinPartitions("u")))
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        ends = materialize(both.groupBy(F.col("u").alias("rid")).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("comp", F.least("rid", "lo")))
        discard(*spent)
        if ends.filter("lo < rid and hi <> lo").isEmpty():
            discard(edges)
            return ends.select("rid", "comp")
        spent = [edges, ends]
        edges = edges.join(ends.select(F.col("rid").alias("v"), "comp"), "v").select("u", F.col("comp").alias("v"))


def _with_groups(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists that still hold different groups; a list of two has been compared already."""
    posts = posts.drop("comp").join(groups, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    open_keys = posts.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter((F.col("lo") < F.col("hi")) & (F.col("c") > 2))
    open_keys = materialize(open_keys.select("key"))
    left = materialize(posts.join(open_keys, "key", "left_semi"))
    discard(open_keys)
    return left


def _posts(classes: DataFrame, percent: int, small: int) -> DataFrame:
    """(key, rid, n, pos, comp) of the lists with several members: subsets up to size small, first shingles above.

    Sets of up to small that may have a larger partner stand in both.
    """
    scanned = _prefixes(classes.filter(100 * F.col("n") >= percent * (small + 1)), percent)
    subsets = classes.filter(F.col("n") <= small).select("rid", "n", "toks").mapInArrow(_enumerate(percent), "key long, rid long, n long, pos long")
    entries = scanned.union(subsets)
    shared = materialize(entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    return entries.join(shared, "key", "left_semi").withColumn("comp", F.col("rid"))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", small_max: int = SMALL_MAX, spent: list[DataFrame] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_size.

    A set holds the distinct shingles of `words` words of a whole text, or its whole word
    sequence if that is shorter. Rows link when 100 * intersection >= percent * union;
    component_id is the least doc_id reachable by links. Null and empty texts have no
    shingles and link with nothing. Rows with a null doc_id get a null component_id and
    link nothing. Repeated rows are copies of one another; a doc_id that comes with
    different texts links by each of them. An empty table gives no rows. Other columns
    are not read, so their names can't clash. Sets of more than small_max shingles are never
    enumerated (their subsets are too many at any rate); any value gives the same result.
    `spent` receives the tables that the result is read from, for a caller to discard behind it.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranked = spark.sparkContext.broadcast(ranked_shingles(docs, words))
    rows = materialize(docs.mapInArrow(_describe(words, percent, small_max, ranked), "doc_id long, n long, sig binary, toks array<long>"))
    classes = materialize(
        rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
        .groupBy("sig")
        .agg(F.min("doc_id").alias("head"), F.count("*").alias("class_size"), F.first("n").alias("n"), F.first("toks").alias("toks"))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    small = boundary(classes, percent, small_max)
    posts = materialize(_posts(classes, percent, small))

    to_sets = _whole_sets(words, ranked)
    tested, groups = [], None
    for turn in range(ROUNDS + 1):
        dense, done_with = None, []
        if turn:
            done_with.append(posts)
            posts = _with_groups(posts, groups)
            if posts.isEmpty():  # no list holds different groups any more
                discard(*done_with)
                break
        if turn < ROUNDS:
            pairs, lists = _hub_pairs(posts, range(turn * HUBS, (turn + 1) * HUBS), percent)
        else:
            long_keys = materialize(posts.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= DENSE).select("key"))
            done_with.append(long_keys)
            if not long_keys.isEmpty():
                dense = _dense_links(posts.join(long_keys, "key", "left_semi"), classes, docs, to_sets, percent)
            pairs, lists = _all_pairs(posts.join(long_keys, "key", "left_anti"), percent, small)
        done_with.append(lists)
        for done in tested:
            pairs = pairs.join(done, ["x", "y"], "left_anti")
        tested.append(materialize(pairs))
        close = materialize(_close(tested[-1], classes, percent))
        links, sets = _linked(close, classes, docs, to_sets, percent)
        if dense is not None:
            links = links.union(dense)
        before, groups = groups, components(links, groups)
        if before is not None and before is not groups:
            done_with.append(before)
        discard(close, sets, *done_with)
    discard(posts, *tested)
    heads = classes.select("rid", "head").join(groups, "rid")
    least = heads.groupBy("comp").agg(F.min("head").alias("component_id"))
    joined = heads.join(least, "comp").select("rid", "component_id")
    by_sig = classes.select("sig", "rid", "head", "class_size").join(joined, "rid", "left")
    by_sig = materialize(by_sig.select("sig", "class_size", F.coalesce("component_id", "head").alias("found")))
    discard(classes, groups)
    if spent is not None:
        spent += [rows, by_sig]
    # Rows without a set are all alike, and need no class.
    has_set = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classed = rows.filter(has_set).join(by_sig, "sig").select("doc_id", F.col("n").alias("n_shingles"), F.col("found").alias("component_id"), "class_size")
    return classed.union(rows.filter(~has_set).select("doc_id", "n", "doc_id", F.lit(1).cast("long")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates: the one of least doc_id.

    Rows without a set stay, as do rows with a null doc_id. Exact repeats of a row's id
    and text count as one document; an id that comes with different texts stays with all
    of them if one heads a group. The columns of docs stay.
    """
    spent: list[DataFrame] = []
    found = materialize(near_duplicates(docs, words, percent, id_col, text_col, spent=spent))
    discard(*spent)
    heads = found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("heads"))
    gone = heads.filter("not heads").select("doc_id").toDF(*new_names(docs, "gone"))
    left = docs.join(gone, docs[id_col].cast("long") == gone[gone.columns[0]], "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    named = left.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
    return named.unionByName(left.filter(F.col(id_col).isNull()))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) p
  JOIN n na ON na.doc_id = p.x JOIN n nb ON nb.doc_id = p.y WHERE 185 * p.c >= 85 * (na.n + nb.n)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, g.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) g USING (doc_id)
"""
