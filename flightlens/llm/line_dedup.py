"""Line dedup by the spread of lines over sites.

A line that stands on many sites is boilerplate. Per line hash a HyperLogLog sketch of
its sites is merged by aggregation; lines whose estimate lies near the threshold are
counted exactly; the others are decided by the sketch. Boilerplate lines go from all
documents, whatever share of a document they are. drop_boilerplate counts a group of near
copies once for a line, so what only copies share stays for near-duplicate removal to
decide.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import discard, materialize, new_names, without_places
from flightlens.llm.ngram_join import near_duplicates

MIN_SITES = 5
MIN_CHARS = 20
#: log2 of the sketch's registers; its relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12
BAND_ERRORS = 4


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(line))


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, site, pos, h1, h2) of every line long enough to count."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    lines = rows.filter(F.length("text") >= min_chars).select("doc_id", "text_hash", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.filter(F.length("line") >= min_chars).withColumn("norm", normal_line(F.col("line"))).filter(F.length("norm") >= min_chars)
    return lines.select("doc_id", "text_hash", "site", "pos", F.xxhash64("norm").alias("h1"), F.crc32(F.col("norm").cast("binary")).alias("h2"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The lines (h1, h2) that stand on at least min_sites different sites; null sites count as none."""
    band = max(1.0, BAND_ERRORS * 1.04 / 2 ** (lg_k / 2) * min_sites)
    low, high = floor(min_sites - band), ceil(min_sites + band)
    sites = lines.filter(F.col("site").isNotNull())
    sketched = sites.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate")).filter(F.col("estimate") >= low)
    sketched = materialize(sketched)
    near = sketched.filter(F.col("estimate") <= high).select("h1", "h2")
    exact = sites.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return sketched.filter(F.col("estimate") > high).select("h1", "h2").union(exact.select("h1", "h2"))


def _of_texts(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> Column:
    """The row of docs is a text of found, whose first columns are doc_id and text_hash under new names."""
    return docs[id_col].cast("long").eqNullSafe(found[found.columns[0]]) & (F.xxhash64(docs[text_col]) == found[found.columns[1]])


def in_distinct_texts(docs: DataFrame, lines: DataFrame, spread: DataFrame, id_col: str, text_col: str, min_texts: int) -> DataFrame:
    """The spread lines (h1, h2) that stand in at least min_texts texts with a site, near copies counted once.

    Copies are told by the n-gram join (five words, 0.8) among the texts with spread lines;
    texts are named by their hash.
    """
    held = materialize(lines.filter(F.col("site").isNotNull()).join(spread, ["h1", "h2"], "left_semi").select("doc_id", "text_hash", "h1", "h2").distinct())
    names = new_names(docs, "line_doc", "line_hash")
    voters = held.select("doc_id", "text_hash").distinct().toDF(*names)
    texts = materialize(docs.join(voters, _of_texts(docs, voters, id_col, text_col), "left_semi").select(F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text")))
    spent: list[DataFrame] = []
    groups = near_duplicates(texts, words=5, percent=80, id_col="text_hash", spent=spent).select(F.col("doc_id").alias("text_hash"), "component_id").distinct()
    votes = held.select("h1", "h2", "text_hash").distinct().join(groups, "text_hash").select("h1", "h2", "component_id").distinct()
    found = materialize(votes.groupBy("h1", "h2").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_texts).select("h1", "h2"))
    discard(held, texts, *spent)
    return found


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, copies_once: bool = False) -> DataFrame:
    """(doc_id, text_hash, gone): positions of the boilerplate lines of each text that has some."""
    lines = materialize(line_table(docs, id_col, text_col, site_col, min_chars))
    spread = spread_lines(lines, min_sites)
    if copies_once:
        spread = in_distinct_texts(docs, lines, materialize(spread), id_col, text_col, min_sites)
    # Few lines are spread over sites, but one may stand in a third of all documents: they are on the small side of this join.
    found = lines.join(spread, ["h1", "h2"], "left_semi")
    # Rows that repeat a whole document repeat its positions.
    found = materialize(found.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")))
    discard(lines)
    return found


def _matched(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """docs with its removals, their positions (null: none), and the text that is left."""
    names = new_names(docs, "line_doc", "line_hash", "line_gone")
    found = found.select("doc_id", "text_hash", "gone").toDF(*names)
    joined, gone = docs.join(found, _of_texts(docs, found, id_col, text_col), "left"), found[names[2]]
    left = F.array_join(without_places(F.split(docs[text_col], "\n", -1), gone), "\n")
    return joined, gone, F.when(gone.isNotNull(), left).otherwise(docs[text_col])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without boilerplate lines; every row and column stays.

    Lines are cut at line feeds and compared trimmed and lower-cased; those shorter than
    min_chars stay. A text that is all boilerplate is left empty, be it a copy of others or
    not. Null and empty texts stay as they are. A null site counts as no site. Rows are told
    apart by id and text; exact repeats are each cleaned. An empty table gives no rows.
    Columns of docs may have any names.
    """
    joined, _, text = _matched(docs, removals(docs, id_col, text_col, site_col, min_sites, min_chars), id_col, text_col)
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs as from dedup_lines, but judged by distinct texts; every row and column stays.

    A line is boilerplate that stands on at least min_sites sites and in at least as many
    texts that are no near copies of one another. Nulls, empty texts, repeated rows, null
    sites, empty tables and clashing names are treated as dedup_lines says.
    """
    joined, _, text = _matched(docs, removals(docs, id_col, text_col, site_col, min_sites, min_chars, copies_once=True), id_col, text_col)
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_spread, n_removed (the same: all go), text_sha256 (of what is left; null text as empty)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).alias("source"))
    joined, gone, text = _matched(docs, removals(docs), "doc_id", "text")
    empty = F.coalesce(docs["text"], F.lit("")) == ""
    spread = F.coalesce(F.size(gone), F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        F.when(empty, 0).otherwise(F.size(F.split(docs["text"], "\n", -1))).cast("long").alias("n_lines"),
        spread.alias("n_spread"),
        spread.alias("n_removed"),
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, str_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, i, ls[i] AS line, lower(trim(ls[i])) AS norm FROM (SELECT doc_id, source, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
s AS (SELECT norm FROM l WHERE length(norm) >= 20 GROUP BY norm HAVING count(DISTINCT source) >= 5),
m AS (SELECT l.*, s.norm IS NOT NULL AS spread FROM l LEFT JOIN s ON l.norm = s.norm),
g AS (SELECT doc_id, count_if(spread) AS n_spread, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT spread) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, CAST(n_spread AS BIGINT) AS n_spread, CAST(n_spread AS BIGINT) AS n_removed,
       sha256(CASE WHEN n_spread > 0 THEN coalesce(kept, '') ELSE text END) AS text_sha256
FROM d JOIN g USING (doc_id)
"""
