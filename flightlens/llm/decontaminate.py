"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows become a hash set that every task holds; each document's
words are hashed, combined pairwise into hashes of 2, 4 and 8 words, and the positions
whose hash is in the set are the probes. Positions are narrow rows, so only probes leave
the scan. A probe is a hit once the document's words themselves equal a window's.

The hash set, the windows and the keys of texts with probes are broadcast up to a checked
size (`max_set`); beyond it the same rows meet them in a shuffled join, which Spark plans and
splits where skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import ascii_lower, materialize, new_names, without_places

WINDOW = 13
#: Probe hashes, words of all windows, and texts with their probes or hits, up to so many of
#: which each of these is broadcast: tens of MB at most.
MAX_SET = 2_000_000
#: Words: runs of 0-9, a-z and non-ASCII characters, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: One word with what stands before it, in the original text.
SEGMENT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
SPANS = (8, 4, 2, 1)


def words_of(text: Column) -> Column:
    """The words of a text; of null none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _doubled(hashes: Column, width: int) -> Column:
    """From hashes of `width` words at each position those of twice as many; cut short at the end."""
    return F.zip_with(hashes, F.slice(hashes, width + 1, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def span_hashes(rows: DataFrame, words: str, spans: Sequence[int]) -> DataFrame:
    """rows with a column h<span> for each span (of 1, 2, 4, 8): hashes of the words from each position on."""
    own = rows.columns
    kept = {}
    if 1 in spans:
        rows, kept[1] = rows.withColumn("h1", F.transform(words, lambda w: F.xxhash64(w))), "h1"
    width, before = 1, words
    while width < max(spans, default=1):  # a column for each step, so that none is computed twice
        rows = rows.withColumn(f"h{2 * width}", _doubled(F.col(before), width))
        width, before = 2 * width, f"h{2 * width}"
        kept[width] = before
    return rows.select(*own, *[kept[s] for s in spans])


def probe_span(length: Column) -> Column:
    """The longest hashed span that fits into a window of `length` words."""
    return F.when(length >= 8, 8).when(length >= 4, 4).when(length >= 2, 2).otherwise(1)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows (item_id, win: words, len, span, probe); items without words have none."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    wins = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("win")).distinct()
    wins = wins.withColumn("len", F.size("win")).withColumn("span", probe_span(F.col("len")))
    hashed = span_hashes(wins, "win", SPANS)
    return hashed.withColumn("probe", F.coalesce(*[F.when(F.col("span") == s, F.col(f"h{s}")[0]) for s in SPANS])).select(*wins.columns, "probe")


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_set: int = MAX_SET,
) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_words, n_hit, n_items, items, hit_positions.

    hit_positions are the 1-based word positions inside any occurrence of a window.
    Null and empty texts have no words and no hits; a benchmark item of fewer than
    `window` words is one window, one without words none. Rows are told apart by doc_id
    and text, so rows that repeat an id with another text have their own figures, and
    exact repeats stay. An empty benchmark or table gives no hits or rows. Other columns
    are not read, so their names can't clash.
    """
    wins = materialize(benchmark_windows(benchmark, window))
    shape = wins.groupBy("span").agg(F.count_distinct("probe").alias("probes"), F.sum("len").alias("words")).collect()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("text_hash"), "t")
    spans = sorted((r.span for r in shape), reverse=True)
    known = wins.select("probe").distinct()
    if sum(r.probes for r in shape) <= max_set:
        known = F.broadcast(known)
    if sum(r.words for r in shape) <= max_set:
        wins = F.broadcast(wins)
    worded = span_hashes(rows.select("doc_id", "text_hash", words_of(F.col("t")).alias("words")), "words", spans)
    # Each span has one hash for each word, so a hash's place tells its position. The outer
    # form, as Spark would put a filter on the array before the other, and make it twice.
    hashes = F.concat(*[f"h{s}" for s in spans]) if spans else F.array().cast("array<bigint>")
    at = worded.select("doc_id", "text_hash", F.size("words").alias("n"), F.posexplode_outer(hashes).alias("i", "probe"))
    probes = at.join(known, "probe", "left_semi").select("doc_id", "text_hash", (F.col("i") % F.col("n") + 1).alias("pos"), "probe").distinct()
    met = materialize(probes.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "probe")).alias("at")))
    # Few texts have probes: while they do, the others stay where they are, unshuffled.
    size = met.agg(F.count("*") + F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    some = F.broadcast(met) if size <= max_set else met
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    held = rows.join(some, same(rows, some), "inner").select(some["doc_id"], some["text_hash"], "t", "at").dropDuplicates(["doc_id", "text_hash"])
    held = held.select("doc_id", "text_hash", words_of(F.col("t")).alias("words"), "at").select("doc_id", "text_hash", "words", F.explode_outer("at").alias("p"))
    # The words behind a probe, as many as the longest window has.
    tried = held.select("doc_id", "text_hash", "p.pos", "p.probe", F.slice("words", F.col("p.pos"), window).alias("ahead"))
    found = tried.join(wins, "probe").filter(F.slice("ahead", F.lit(1), F.col("len")) == F.col("win"))
    hits = materialize(
        found.groupBy("doc_id", "text_hash").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + F.col("len") - 1))))).alias("hit_positions"),
            F.array_sort(F.collect_set("item_id")).alias("items"),
        )
    )
    keyed = rows.select("doc_id", "text_hash", F.size(words_of(F.col("t"))).cast("long").alias("n_words"))
    return keyed.join(hits, same(keyed, hits), "left").select(
        keyed["doc_id"],
        keyed["text_hash"],
        "n_words",
        F.coalesce(F.size("hit_positions"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hit_positions", F.array().cast("array<int>")).alias("hit_positions"),
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or, with remove='spans', without their hit words.

    The columns of docs stay. Removing spans takes each hit word of a contaminated
    document with what stands before it; everything else stays as it was written.
    Nulls, repeats and empty tables are treated as find_hits says.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = find_hits(docs, benchmark, window, id_col, text_col)
    bad_id, bad_hash, bad_at = new_names(docs, "bad_id", "bad_hash", "bad_at")
    bad = (
        found.filter(contaminated(F.col("n_hit"), F.col("n_words")))
        .select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash), F.col("hit_positions").alias(bad_at))
        .distinct()
    )
    if remove == "documents":
        bad = bad.select(bad_id, bad_hash)
    bad = materialize(bad)
    if bad.agg(F.count("*") + F.coalesce(F.sum(F.size(bad_at)), F.lit(0)) if remove == "spans" else F.count("*")).first()[0] <= MAX_SET:
        bad = F.broadcast(bad)
    text = F.coalesce(docs[text_col], F.lit(""))
    same = docs[id_col].cast("long").eqNullSafe(bad[bad_id]) & (F.xxhash64(text) == bad[bad_hash])
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    segments = F.regexp_extract_all(text, F.lit(SEGMENT), 0)
    rest = without_places(segments, F.transform(bad[bad_at], lambda p: p - 1))
    cleaned = F.concat(F.array_join(rest, ""), F.regexp_extract(text, TAIL, 0))
    joined = docs.join(bad, same, "left")
    return joined.select(*[F.when(bad[bad_id].isNotNull() | bad[bad_hash].isNotNull(), cleaned).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM bw WHERE len(w) > 0)),
dpos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM dw),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT d.doc_id, d.i, s.n, array_to_string(d.w[d.i:d.i + s.n - 1], ' ') AS s
  FROM dpos d JOIN sizes s ON d.i + s.n - 1 <= len(d.w)),
hit AS (SELECT o.doc_id, o.i, o.n, win.item_id FROM occ o JOIN win ON win.n = o.n AND win.s = o.s),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(it, ',' ORDER BY it) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS it FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
