"""URL filters: rules on hosts and path prefixes, found by hash joins.

Each URL is expanded into expressions host-suffix + path-prefix; rules are expressions
too. An equi-join on the first 4 bytes of the SHA-256 digest proposes rules, the full
digest confirms them, and of the rules that fit the longest wins. Only suffixes and
prefixes of lengths that some rule has are expanded, so the expansion is bounded by the
rules' shapes, not by a URL's length.

Defined cases: a null URL, or one without ``://``, has empty host and path and meets no
rule; repeated URLs are judged once and each row gets the verdict; equal rules with
different verdicts: block wins; no rule at all: every URL gets the default verdict; URLs of
any length are judged whole; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(after, r"\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of (text, prefix): suffixes of ``host`` of so many labels, each with prefixes of ``path`` of so many characters."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.filter(F.array(*map(F.lit, labels)).cast("array<int>"), lambda k: k <= F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    paths = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length(path)), lambda k: F.substring(path, F.lit(1), k))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def rules_table(rules: DataFrame) -> DataFrame:
    """``rules`` (host, path, verdict) with expr and its digest; of equal rules block wins."""
    made = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.col("path"), "verdict").filter("host is not null and path is not null")
    made = made.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
    made = made.withColumn("expr", F.concat("host", "path"))
    return made.select("expr", "verdict", F.length("expr").alias("length"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"), digest(F.col("expr")).alias("full"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null: none) and verdict of each row of ``pages`` (page_id, url)."""
    table = rules_table(rules)
    shape = table.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()  # lengths of rules: bounded by the longest rule
    rows = pages.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    if not shape["labels"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    places = rows.select("host", "path").distinct()
    found = places.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), sorted(shape["labels"]), sorted(shape["lengths"]))).alias("tried"))
    found = found.withColumn("tried_full", digest(F.col("tried"))).withColumn("short", F.substring("tried_full", 1, PREFIX_HEX))
    short = table.withColumn("short", F.substring("full", 1, PREFIX_HEX))
    fits = found.join(short, "short").filter(F.col("tried_full") == F.col("full"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("length", F.col("verdict").alias("verdict"), F.col("expr").alias("rule"))).alias("best"))
    # pages without a host are one key; the hash as a further key gives the join exchanges of its own, whose partitions can be split
    judged = rows.join(best.select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", F.col("best.verdict").alias("told")), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")) & (F.xxhash64("host", "path") == F.xxhash64("h", "p")), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("told", F.lit(default)).alias("verdict"))


#: Host, path and verdict of the query's rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
