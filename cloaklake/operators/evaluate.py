"""Accuracy of detection: expected against detected entities, and precision, recall and F1 over all, by type and by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def verdicts(cases: DataFrame) -> DataFrame:
    """id, language, verdict (TP, FN, FP), type, text, start, end, score, passed.

    cases: id, language, expected (array of type, text), detected (array of type, text, start, end, score). Each expected
    entity, in order, takes the first detected one not yet taken of its type whose text holds its text; case and outer blanks
    don't matter. What is left over on either side is FN or FP. A case passes without either.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("hit"))

    def match(acc: Column, e: Column) -> Column:
        place = F.transform("detected", lambda d, i: F.when(~F.array_contains(acc.used, i) & (d.type == e.type) & F.contains(_norm(d.text), _norm(e.text)), i))
        first = F.get(F.array_compact(place), F.lit(0))
        return F.struct(F.when(first.isNull(), acc.used).otherwise(F.array_append(acc.used, first)).alias("used"), F.array_append(acc.hit, F.coalesce(first, F.lit(-1))).alias("hit"))

    m = cases.withColumn("m", F.aggregate("expected", start, match))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda v, kind, text, s, e, p: F.struct(F.lit(v).alias("verdict"), kind.alias("type"), text.alias("text"), s.alias("start"), e.alias("end"), p.alias("score"))

    def judged(e: Column, i: Column) -> Column:
        at = F.get("m.hit", i)
        d = F.get("detected", at)
        return F.when(at >= 0, row("TP", e.type, e.text, d.start, d.end, d.score)).otherwise(row("FN", e.type, e.text, none("int"), none("int"), none("double")))

    left = F.filter(F.transform("detected", lambda d, i: F.struct(d.alias("d"), i.alias("i"))), lambda x: ~F.array_contains("m.used", x.i))
    extra = F.transform(left, lambda x: row("FP", x.d.type, x.d.text, x.d.start, x.d.end, x.d.score))
    passed = F.forall("m.hit", lambda h: h >= 0) & (F.size("m.used") == F.size("detected"))
    out = m.select("id", "language", passed.alias("passed"), F.explode_outer(F.concat(F.transform("expected", judged), extra)).alias("v"))
    return out.select("id", "language", "v.verdict", "v.type", "v.text", "v.start", "v.end", "v.score", "passed")


def metrics(rows: DataFrame) -> DataFrame:
    """scope (all, type, language), key, total, passed, failed (cases), tp, fp, fn, precision, recall, f1. rows: verdicts()."""
    scoped = rows.select("id", "passed", "verdict", F.explode(F.array(
        F.struct(F.lit("all").alias("scope"), F.lit("all").alias("key")),
        F.struct(F.lit("type").alias("scope"), F.col("type").alias("key")),
        F.struct(F.lit("language").alias("scope"), F.col("language").alias("key")),
    )).alias("s")).select("id", "passed", "verdict", "s.scope", "s.key").filter("key is not null")
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v.lower())
    out = scoped.groupBy("scope", "key").agg(
        F.count_distinct("id").alias("total"), F.count_distinct(F.when(F.col("passed"), F.col("id"))).alias("passed"), n("TP"), n("FP"), n("FN")
    )
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0)))
    p = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0))
    r = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(1.0))
    out = out.withColumns({"failed": F.col("total") - F.col("passed"), "precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))).otherwise(0.0)
    return out.withColumn("f1", f1)


def misses(rows: DataFrame, verdict: str = "FN") -> DataFrame:
    return rows.filter(F.col("verdict") == verdict).select("id", "language", "type", "text", "start", "end", "score")
