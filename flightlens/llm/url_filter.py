"""URL filter: host-suffix and path-prefix expressions matched by short hash prefix.

Each url is expanded into the pairs (host suffix at a label boundary, path prefix)
that a rule could hold. An expression and a rule meet in an equi-join on the first
characters of their SHA-256 digests; a meeting counts once the full digests agree.
The longest rule decides. The expansion is bounded by the rules: only suffixes of at
most as many labels as the longest rule host, and only path prefixes of lengths that
some rule path has, so any rule path is met, at a slash or not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.llm.common import ascii_lower

#: (verdict, host, path) of the production rule list.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
PREFIX_CHARS = 8


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """A rule table (verdict, host, path)."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; without :// empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; without :// empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, max_labels: int, path_lengths: list[int]) -> Column:
    """Array of host_suffix / path_prefix strings that a rule could equal; no host holds a slash, so the first one parts them."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max_labels))),
        lambda k: F.array_join(F.slice(labels, -k, k), "."),
    )
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(lengths, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("/"), p))))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    rule is the host and path of the longest fitting rule, null if none fits; the
    verdict is then `default`. Of equally long rules that fit, the one with the longer host
    decides; of repeated rules with different verdicts, block wins. Null urls, and urls without
    ://, have an empty host and path and fit no rule. A rule with a null or empty host, a host
    that holds /, ? or #, or a path that neither is empty nor begins with / fits nothing. No
    rules: all rows get the default. Repeated rows stay; other columns of pages are not read, so
    their names can't clash.
    """
    known = (
        rules.select(ascii_lower(F.col("host")).alias("h"), "path", "verdict")
        .filter((F.col("h") != "") & ~F.col("h").rlike("[/?#]") & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy("h", "path")
        .agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("rule_verdict"))
        .select(
            F.concat("h", "path").alias("rule"),
            F.concat("h", F.lit("/"), "path").alias("expr"),
            "rule_verdict",
            F.length("h").alias("host_chars"),
            F.size(F.split("h", r"\.", -1)).alias("n_labels"),
            F.length("path").alias("n_path"),
        )
    )
    shape = known.agg(F.max("n_labels").alias("most"), F.collect_set("n_path").alias("lengths")).first()
    urls = pages.select(
        F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    if shape.most is None:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Decisions hang on (host, path) alone, so each distinct pair is matched once.
    met = (
        urls.filter(F.col("host") != "")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shape.most, sorted(shape.lengths))).alias("expr"))
        .withColumn("digest", F.sha2("expr", 256))
        .withColumn("short", F.substring("digest", 1, prefix_chars))
    )
    hashed = known.select("rule", "rule_verdict", "host_chars", F.sha2("expr", 256).alias("rule_digest")).withColumn(
        "short", F.substring("rule_digest", 1, prefix_chars)
    )
    decided = (
        met.join(hashed, "short")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_chars", "rule", "rule_verdict")).alias("best"))
    )
    return urls.join(decided, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
