"""Detection over spans: role and type filters, thresholds, whitelist, and roll-ups by request."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals, language, patterns
from ..functions.arrays import once
from ..sources.config import Pii, Secrets
from ..sources.languages import contexts
from .extract import joined_text, span_list


def role_scanned(roles: tuple | list | None, role: Column | str = "role") -> Column:
    """Whether a span is scanned: always if no roles are listed or it has none."""
    role = F.col(role) if isinstance(role, str) else role
    return F.lit(True) if not roles else role.isNull() | role.isin(list(roles))


def not_whitelisted(text: Column, hits: Column, whitelist: tuple | list) -> Column:
    """Hits whose text neither is part of a whitelisted text nor holds one."""
    if not whitelist:
        return hits
    listed = F.lit(list(whitelist))
    clear = lambda v: ~F.exists(listed, lambda w: F.contains(w, v) | F.contains(v, w))
    return patterns.with_cutter(text, hits, lambda c, hs: F.filter(hs, lambda h: once(patterns.cut_hit(c, h), clear)))


def pii_hits(text: Column, config: Pii, lang: Column | None = None, whitelist: tuple | list = ()) -> Column:
    """Hits of the configured types, at or above the threshold, not whitelisted; none in empty texts. Types without a recogniser
    (PERSON and LOCATION, unless one was registered) have no hits."""
    known = [t for t in patterns.REGISTRY if t in config.entities and t not in patterns.SECRETS]
    found = patterns.detect(text, known, language=lang, contexts=contexts(list(config.languages)))
    found = F.filter(found, lambda h: h.score >= config.score_threshold)
    return F.coalesce(not_whitelisted(text, found, whitelist), patterns.no_hits())


def secret_hits(text: Column, config: Secrets) -> Column:
    """Hits of the configured secret types in the first max_scan_chars characters, last first; none if disabled."""
    if not config.enabled:
        return patterns.no_hits()
    found = F.coalesce(patterns.detect(text, list(config.entities), config.max_scan_chars), patterns.no_hits())
    return F.sort_array(found, asc=False)


def detect_secrets(spans: DataFrame, config: Secrets) -> DataFrame:
    """spans with secrets: the span's hits."""
    return spans.withColumn("secrets", F.when(role_scanned(config.scan_roles), secret_hits(F.col("text"), config)).otherwise(patterns.no_hits()))


def secret_counts(detected: DataFrame) -> DataFrame:
    """request_id, entity_type, count over all spans of a request."""
    hits = detected.select("request_id", F.explode("secrets").alias("h"))
    return hits.groupBy("request_id", F.col("h.entity_type").alias("entity_type")).agg(F.count("*").alias("count"))


def languages_of(spans: DataFrame, config: Pii) -> DataFrame:
    """request_id and the language of its messages' texts, found once for each request; with one language, that one."""
    found = language.detect_language(F.col("text"), list(config.languages), config.fallback_language)
    return joined_text(spans).select("request_id", found.alias("l")).select("request_id", F.col("l.language").alias("language"), F.col("l.used_fallback").alias("language_fallback"), F.col("l.detected").alias("detected_language"))


def analyze(spans: DataFrame, config: Pii, whitelist: tuple | list = ()) -> DataFrame:
    """spans with pii (hits, not yet resolved), language, language_fallback, detected_language; if disabled, no hits, and English."""
    if not config.enabled:
        return spans.withColumns({"language": F.lit("en"), "language_fallback": F.lit(False), "detected_language": F.lit(None).cast("string"), "pii": patterns.no_hits()})
    out = spans.join(languages_of(spans, config), "request_id")
    raw = F.when(role_scanned(config.scan_roles) & (F.col("text") != ""), pii_hits(F.col("text"), config, F.col("language"), whitelist)).otherwise(patterns.no_hits())
    return out.withColumn("pii", raw)


def roll_up(analyzed: DataFrame) -> DataFrame:
    """request_id, has_pii, entity_types (in the order of their first hit, spans in order), n_entities, language columns."""
    hits = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "pii"))), lambda s: s.pii))
    types = F.array_distinct(F.transform(hits, lambda h: h.entity_type))
    out = analyzed.groupBy("request_id", "language", "language_fallback", "detected_language").agg(types.alias("entity_types"), F.size(hits).alias("n_entities"))
    return out.withColumn("has_pii", F.col("n_entities") > 0)


def analyze_requests(requests: DataFrame, dialect: str, config: Pii, whitelist: tuple | list = ()) -> DataFrame:
    """roll_up(analyze(spans)) of parsed requests, each in its own row: no exchange, and no span in a row of its own."""
    df = requests.select("request_id", F.transform(span_list(dialect), lambda x: F.struct(x.role.alias("role"), x.message_idx.alias("message_idx"), x.text.alias("text"))).alias("_p"))
    df = df.withColumn("_l", language_in(F.col("_p"), config)).withColumn("_h", hits_in(F.col("_p"), F.col("_l.language"), config, whitelist))
    out = df.select("request_id", F.col("_l.language").alias("language"), F.col("_l.used_fallback").alias("language_fallback"), F.col("_l.detected").alias("detected_language"), F.flatten("_h").alias("_h"), (F.size("_p") > 0).alias("_some"))
    own = F.struct("request_id", "language", "language_fallback", "detected_language", F.array_distinct(F.transform("_h", lambda h: h.entity_type)).alias("entity_types"), F.size("_h").alias("n_entities"))
    # requests without spans go here, not by a filter, which Spark would push before the table is dealt out, where spans would be made once more
    out = out.select(F.explode(F.filter(F.array(own), lambda x: F.col("_some"))).alias("x")).select("x.*")
    return out.withColumn("has_pii", F.col("n_entities") > 0)


def language_in(spans: Column, config: Pii) -> Column:
    """The language of a request's spans (an array of role, message_idx, text): of its messages' texts together; if disabled, English."""
    if not config.enabled:
        return language.answer(F.lit("en"), F.lit(False), F.lit(None).cast("string"))
    said = F.transform(F.filter(spans, lambda x: x.message_idx >= 0), lambda x: x.text)
    return language.detect_language(F.array_join(said, "\n"), list(config.languages), config.fallback_language)


def hits_in(spans: Column, lang: Column, config: Pii, whitelist: tuple | list = ()) -> Column:
    """The hits of each of a request's spans (an array of role, message_idx, text), not yet resolved; none if disabled."""
    if not config.enabled:
        return F.transform(spans, lambda x: patterns.no_hits())
    scanned = lambda x, own: F.when(role_scanned(config.scan_roles, x.role) & (x.text != ""), pii_hits(x.text, config, own, whitelist)).otherwise(patterns.no_hits())
    return once(F.struct(spans.alias("p"), lang.alias("lang")), lambda y: F.transform(y.p, lambda x: scanned(x, y.lang)))


def resolved_pii(hits: Column) -> Column:
    return intervals.resolve_by_score(hits)


def resolved_secrets(hits: Column) -> Column:
    return intervals.resolve_by_start(hits)


def with_model_hits(spans: DataFrame, model: Callable[[list[str]], list[list[tuple[int, int, str, float]]]], column: str = "model_hits") -> DataFrame:
    """spans with the hits of a plugged-in model (for PERSON and LOCATION): texts to lists of (start, end, type, score), in Arrow batches."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = model([t if t is not None else "" for t in f["text"]])
            yield f.assign(**{column: [[{"start": s, "end": e, "entity_type": t, "score": float(p)} for s, e, t, p in x] for x in found]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields)
    return spans.mapInPandas(work, f"{fields}, {column} {patterns.HIT}")
