"""URL filters: every url against host and path rules, by an equi-join on hash prefixes.

A url stands for one expression per (host suffix, path prefix). Rules and expressions meet
on the first 32 bits of their SHA-256 and are confirmed by the whole digest; among the rules
that fit a url the longest wins. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm.common import free_name, table

#: Fixed values of the query's contract: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Up to so many rules (about 20 MB) go to every executor; more are joined by shuffle.
BROADCAST_RULES = 200_000
#: Parts that one expression is dealt to in a shuffled join: every url has the host ``com``.
SALTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    # A blank can't be part of a host label here, so the two parts stay apart.
    return F.sha2(F.concat_ws(" ", host, path).cast("binary"), 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def url_rules(spark: SparkSession, rows: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rows), "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict`` (``allow`` or ``block``). A rule fits its host and all
    subdomains if the url's path starts with the rule's path. The longest host + path wins,
    of equally long ones the longer host; if both verdicts stand for one rule, ``block``. No
    rule: rule null and ``default``. Null urls and urls without ``://`` have empty parts. Rules
    with a null part are left out. Columns of ``pages`` named like an added one are replaced;
    repeated rows stay, an empty table gives an empty result.
    """
    lists = _deepest(rules)
    known = _digests(rules)
    small = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    # Each distinct url is judged once, without the other columns.
    urls = pages.select(F.col(url).cast("string").alias("url")).distinct()
    split = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    digests = split.withColumn("digest", F.explode(_expressions(F.col("host"), F.col("path"), lists)))
    known = known.withColumnRenamed("digest", "rule_digest")
    fits = _prefix(F.col("digest")) == _prefix(F.col("rule_digest"))
    if small:
        known = F.broadcast(known)
    else:
        digests = digests.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
        known = known.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fits &= F.col("salt") == F.col("rule_salt")
    fits &= F.col("digest") == F.col("rule_digest")  # the whole digest confirms what the prefix found
    best = F.max(F.when(F.col("rule_digest").isNotNull(), F.struct("rank", "rule", "verdict")))
    joined = digests.join(known, fits, "left").groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    base = pages.drop(*(c for c in ("host", "path", "rule", "verdict") if c != url))
    held = {n: free_name(base, f"judged_{n}") for n in ("url", "host", "path", "rule", "verdict")}
    judged = joined.select(
        F.col("url").alias(held["url"]), F.col("host").alias(held["host"]), F.col("path").alias(held["path"]),
        F.col("best.rule").alias(held["rule"]), F.coalesce("best.verdict", F.lit(default)).alias(held["verdict"]),
    )
    met = base.join(judged, F.col(url).cast("string").eqNullSafe(F.col(held["url"])), "left")
    kept = [c for c in base.columns if c not in ("host", "path", "rule", "verdict")]
    return met.select(*kept, *(F.col(held[n]).alias(n) for n in ("host", "path", "rule", "verdict")))


def _digests(rules: DataFrame) -> DataFrame:
    """One row per rule, with what orders the rules that fit one url."""
    host, path = F.col("host"), F.col("path")
    rank = F.struct((F.length(host) + F.length(path)).alias("length"), F.length(host).alias("host"))
    return (
        rules.where(host.isNotNull() & path.isNotNull() & F.col("verdict").isNotNull())
        .groupBy(host, path).agg(F.max("verdict").alias("verdict"))
        .select(_digest(host, path).alias("digest"), rank.alias("rank"), F.concat(host, path).alias("rule"), "verdict")
    )


def _deepest(rules: DataFrame) -> tuple[int, int, list[int]]:
    """Most labels and slashes of a rule, and the lengths of paths that don't end at a slash.

    One row, however many rules there are; longer expressions of a url fit none of them.
    """
    path = F.col("path")
    labels, slashes, lengths = rules.agg(
        F.max(F.size(F.split("host", r"\."))),
        F.max(F.length(path) - F.length(F.replace(path, F.lit("/")))),
        F.sort_array(F.collect_set(F.when(~path.endswith("/"), F.length(path)))),
    ).first()
    return labels or 0, slashes or 0, lengths or []


def _expressions(host: Column, path: Column, lists: tuple[int, int, list[int]]) -> Column:
    labels, slashes, lengths = lists
    parts = F.split(host, r"\.")
    depth = F.least(F.size(parts), F.lit(labels))
    hosts = F.transform(
        F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        lambda n: F.call_function("substring_index", host, F.lit("."), -n),
    )
    cuts = F.split(path, "/")
    steps = F.least(F.size(cuts) - 1, F.lit(slashes))
    prefixes = F.transform(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        lambda n: F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")),
    )
    if lengths:
        fixed = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
        prefixes = F.concat(prefixes, F.transform(fixed, lambda n: F.substring(path, F.lit(1), n)))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    return F.when(F.size(pairs) > 0, F.array_distinct(pairs)).otherwise(F.array(F.lit("")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, url_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_VALUES}),
rest AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT n, arg_max(rhost || rpath, length(rhost || rpath) * 10000 + length(rhost)) AS rule,
    arg_max(rverdict, length(rhost || rpath) * 10000 + length(rhost)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (n)
"""
