"""Statistics, breakdowns and pages over the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def stats(log: DataFrame, as_of: Column) -> DataFrame:
    """One row, from one scan: nine numbers about the log; an empty log gives zeros."""
    total, pii = F.count("*"), F.count_if(F.col("pii_detected") == 1)
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return log.agg(
        total.alias("total_requests"),
        pii.alias("pii_requests"),
        F.when(total > 0, half_up(pii / F.nullif(total, F.lit(0)) * 100 * 10) / 10).otherwise(0.0).alias("pii_percentage"),
        F.count_if(F.col("provider").isin("openai", "anthropic")).alias("proxy_requests"),
        F.count_if(F.col("provider") == "local").alias("local_requests"),
        F.count_if(F.col("provider") == "api").alias("api_requests"),
        half_up(F.coalesce(F.avg("scan_time_ms"), F.lit(0.0))).alias("avg_scan_time_ms"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"),
        F.count_if(F.col("timestamp") >= as_of - F.expr("INTERVAL 1 HOUR")).alias("requests_last_hour"),
    )


def entity_stats(log: DataFrame) -> DataFrame:
    """entity, count over the comma lists, blanks and empty entries left out; most frequent first."""
    names = log.filter("entities is not null and entities <> ''").select(F.explode(F.split("entities", ",")).alias("e"))
    return names.select(F.trim("e").alias("entity")).filter("entity <> ''").groupBy("entity").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "entity")


def page(log: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """The latest rows. limit 1 to 1000, offset 0 or more."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000, offset 0 or more")
    return log.orderBy(F.desc("timestamp"), F.desc("id")).offset(offset).limit(limit)


def page_info(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    return rows.agg(F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), F.count("*").alias("count"))


def provider_split(stats_row: DataFrame) -> DataFrame:
    """Shares in percent of proxied and local requests; halves without either."""
    both = F.col("proxy_requests") + F.col("local_requests")
    share = F.when(both > 0, half_up(F.col("proxy_requests") / F.nullif(both, F.lit(0)) * 100)).otherwise(50)
    return stats_row.select(share.cast("long").alias("proxy_percent"), (100 - share).cast("long").alias("local_percent"))


def top_entities(counts: DataFrame, most: int = 6) -> DataFrame:
    """The chart: the most frequent entities with their bar's width in percent of the longest."""
    top = counts.orderBy(F.desc("count"), "entity").limit(most)
    return top.withColumn("width", F.col("count") / F.max("count").over(Window.partitionBy(F.lit(1))) * 100)


def row_entity_counts(log: DataFrame) -> DataFrame:
    """id, entity, count within each row."""
    names = log.select("id", F.explode(F.split("entities", ",")).alias("e")).select("id", F.trim("e").alias("entity"))
    return names.filter("entity <> ''").groupBy("id", "entity").agg(F.count("*").alias("count"))


def display(log: DataFrame) -> DataFrame:
    """id, is_error (a null status is fine), language_shown (detected to used, where it fell back), has_secrets, entity_list."""
    fell = (F.col("language_fallback") == 1) & F.col("detected_language").isNotNull()
    listed = F.filter(F.transform(F.split(F.coalesce("entities", F.lit("")), ","), lambda e: F.trim(e)), lambda e: e != "")
    return log.select(
        "id",
        F.coalesce(F.col("status_code") >= 400, F.lit(False)).alias("is_error"),
        F.when(fell, F.concat("detected_language", F.lit(" -> "), "language")).otherwise(F.col("language")).alias("language_shown"),
        F.coalesce(F.col("secrets_detected") == 1, F.lit(False)).alias("has_secrets"),
        listed.alias("entity_list"),
    )


def highlighted(text: Column) -> Column:
    """Masked text as HTML: escaped, placeholders marked."""
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.regexp_replace(safe, r"(\[\[[A-Z_]+_[0-9]+\]\])", "<mark>$1</mark>")
