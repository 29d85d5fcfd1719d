"""URL filters by hashed expressions.

DataFrame functions only. A url is expanded into expressions, each a suffix of its
host at a label boundary and a prefix of its path, and these are equi-joined on a short
hash prefix with the rules, which are held together by short hash; among those of an
expression's short hash the full digest confirms a match, so a short hash that two
expressions share decides nothing. The longest rule wins, then the one with the
longer host, then block. Urls are expanded only to the label counts and path lengths
that rules have, so a hostile url costs no more expressions than there are such pairs.

Lengths and label counts are arrays, so a plan does not grow with the rules.

Rules are broadcast if there are at most ``BROADCAST_ROWS``; beyond, both sides are
shuffled, and expressions that many urls share are matched once for each: the distinct
expressions are added up before the join and the verdicts go back by expression, in
plain joins that Spark splits where an expression is common.

Defined results: host and path are empty for a null url or one without ``://``; such
urls, and those that no rule fits, get the default verdict; repeated rows each get a
row; null page ids are kept. A rule whose host or path is null fits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are broadcast at most: of fixed width (hashes, lengths) but for the rule string.
BROADCAST_ROWS = 200_000
#: Hex digits of the short hash.
SHORT = 8

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; empty if there are none."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substr(url, start + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """(short, rules) of each short hash: array of (full, length, host_length, verdict, rule)."""
    clean = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    best = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block over allow
    full = digest(F.col("host"), F.col("path"))
    own = F.struct(full.alias("full"), F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), "verdict", F.concat("host", "path").alias("rule"))
    return best.groupBy(F.substring(full, 1, SHORT).alias("short")).agg(F.collect_list(own).alias("rules"))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Digests of the host suffixes of so many labels with the path prefixes of such lengths."""
    # substring_index gives the whole host if it has fewer labels
    suffixes = F.array_distinct(F.transform(F.lit(labels), lambda n: F.call_function("substring_index", host, F.lit("."), -n)))
    prefixes = F.transform(F.filter(F.lit(lengths), lambda n: F.length(path) >= n), lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: digest(s, p))))


def confirmed(full: Column, rules: Column) -> Column:
    """Of the rules of a short hash the one with this digest."""
    return F.filter(rules, lambda r: r["full"] == full)[0]


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all
    subdomains if the path starts with the rule's.
    """
    spark = pages.sparkSession
    known = rules.where("host IS NOT NULL AND path IS NOT NULL").agg(
        F.collect_set(F.size(F.split("host", "\\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n")
    ).first()
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    if not known["n"]:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    matches = rule_table(rules)
    digests = expressions(F.col("host"), F.col("path"), sorted(known["labels"]), sorted(known["lengths"]))
    each = parsed.withColumn("row", F.monotonically_increasing_id())  # equal rows are judged one by one
    exploded = each.select("*", F.explode_outer(digests).alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    if known["n"] <= BROADCAST_ROWS:
        joined = exploded.join(F.broadcast(matches), "short", "left").withColumn("hit", confirmed(F.col("full"), F.col("rules")))
    else:
        used = exploded.select("full", "short").where("full IS NOT NULL").distinct()
        hits = used.join(materialize(matches, "rules"), "short").select(F.col("full").alias("known"), confirmed(F.col("full"), F.col("rules")).alias("hit"))
        joined = exploded.join(materialize(hits.where("hit IS NOT NULL"), "hits"), F.col("full") == F.col("known"), "left")
    best = F.max(F.when(F.col("hit").isNotNull(), F.struct("hit.length", "hit.host_length", "hit.verdict", "hit.rule")))
    judged = joined.groupBy("row").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path")), best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = """
WITH r AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rh, rp, v)
), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u
), p AS (
  SELECT row_number() OVER () AS i, page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h
), m AS (
  SELECT p.i, r.rh || r.rp AS rule, r.v, row_number() OVER (PARTITION BY p.i ORDER BY length(r.rh || r.rp) DESC) AS k
  FROM p JOIN r ON (p.host = r.rh OR suffix(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m ON p.i = m.i AND m.k = 1
"""
