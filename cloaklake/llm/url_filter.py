"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

Plan, DataFrame functions only: the distinct (host, path) pairs are expanded into the expressions that a rule could have (as
many labels of the host, as many leading characters of the path, as any rule has), joined with the rules on the first 32 bits
of SHA-256, confirmed by the whole digest; the longest rule wins. The exploded rows stay in the partitioning of the distinct
pairs, so the winner needs no further exchange. The rules are broadcast only while their number is at most `broadcast_rules`.
A hot URL is one pair; joining the verdicts back is an equi-join that adaptive execution splits where it is skewed.

Defined results: a null URL, or one without "://", has host and path empty and gets the default verdict; repeated rows each
get their verdict; an empty table gives an empty result; other columns of the input are untouched (own columns that clash
with host, path, rule or verdict are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    return F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules with their digest; of equal (host, path) the blocking one stays."""
    df = spark.createDataFrame(rules, "verdict string, host string, path string")
    df = df.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    text = F.concat("host", "path")
    return df.select(
        text.alias("rule"), F.sha2(text, 256).alias("digest"), "verdict",
        F.size(F.split("host", r"\.")).alias("labels"), F.length("host").alias("host_len"), F.length("path").alias("path_len"),
    )


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict."""
    spark = df.sparkSession
    table = rule_table(spark, rules)
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    parsed = df.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    labels = F.size(F.split("host", r"\."))
    expressions = [
        F.when((labels >= k) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)))
        for k, n in shapes
    ]
    pairs = parsed.select("host", "path").distinct()
    tried = pairs.select("host", "path", F.explode_outer(F.array_compact(F.array(*expressions)) if expressions else F.array().cast("array<string>")).alias("expression"))
    tried = tried.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8))
    keyed = table.withColumn("short", F.substring("digest", 1, 8)).withColumnRenamed("digest", "whole")
    keyed = F.broadcast(keyed) if len(rules) <= broadcast_rules else keyed
    found = tried.join(keyed, (tried.short == keyed.short) & (tried.digest == keyed.whole), "left")
    name = fresh(df, "best")
    best = found.groupBy("host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct((F.col("host_len") + F.col("path_len")).alias("n"), "host_len", "rule", keyed.verdict.alias("verdict")))).alias(name)
    )
    out = parsed.join(best, ["host", "path"], "left")
    kept = [parsed[f"`{c}`"] for c in parsed.columns]
    return out.select(*kept, F.col(f"{name}.rule").alias("rule"), F.coalesce(f"{name}.verdict", F.lit(default)).alias("verdict"))
