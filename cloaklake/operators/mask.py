"""Masking of single texts and of requests with many spans, and what the mask service answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language, placeholders
from ..functions.arrays import fresh
from ..functions.patterns import no_hits
from ..sources.config import Config, Pii, Secrets
from .detect import pii_hits, resolved_pii, resolved_secrets, secret_hits
from .extract import KEYS, rebuilt


def first_text(masked: Column | str) -> Column:
    return F.get(F.col(f"{masked}.texts") if isinstance(masked, str) else masked.texts, F.lit(0))


def mask_requests(spans: DataFrame, hits: str, seeds: DataFrame | None = None) -> DataFrame:
    """request_id, spans (span_ord, path, places, text, masked), context: one numbering for all spans of a request, in their order.

    hits: the column with resolved hits. seeds: request_id, start_from. One exchange, by request.
    """
    fields = ["span_ord", "path", "message_idx", "part_idx", "nested_idx", "text", F.col(hits).alias("hits")]
    out = spans.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("s"))
    start = None
    if seeds is not None:
        out, start = out.join(seeds, "request_id", "left"), F.coalesce("start_from", F.create_map().cast("map<string,int>"))
    out = placeholders.masked(out, F.col("s"), "m", start)
    own = F.transform(F.arrays_zip(F.col("s"), F.col("m.texts").alias("masked")), lambda z: F.struct(z.s.span_ord.alias("span_ord"), z.s.path.alias("path"), z.s.message_idx.alias("message_idx"), z.s.part_idx.alias("part_idx"), z.s.nested_idx.alias("nested_idx"), z.s.text.alias("text"), z.masked.alias("masked"), (F.size(z.s.hits) > 0).alias("changed")))
    keep = ["request_id", own.alias("spans"), F.col("m.context").alias("context")]
    return out.select(*keep, *(["start_from"] if seeds is not None else []))


def mask_large(spans: DataFrame, hits: str, seeds: DataFrame | None = None, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """For requests too large for one row: (spans with `masked`, mapping), numbered as mask_requests() does, by joins and windows alone.

    The first place of each value of a request is found by a grouping, with partial sums on the way. Values are numbered within
    blocks of `block` spans, and blocks by running counts, so no task has more of a request than a block of spans, one row
    for each of its blocks, or what a value's rows are split into. mapping: request_id, placeholder, value, entity_type, n.
    seeds: request_id, start_from. A span without hits keeps its text; a null text is an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    each = spans.filter(F.size(hits) > 0).select("request_id", "span_ord", text.alias("text"), F.explode(hits).alias("h"))
    each = each.select("request_id", "span_ord", F.col("h.start").alias("start"), F.col("h.entity_type").alias("entity_type"), F.substring("text", F.col("h.start") + 1, F.col("h.end") - F.col("h.start")).alias("value"))
    first = each.groupBy("request_id", "value").agg(F.min(F.struct("span_ord", "start", "entity_type")).alias("first")).select("request_id", "value", "first.*")
    first = first.withColumn("block", F.floor(F.col("span_ord") / block))
    kind = ["request_id", "entity_type"]
    counts = first.groupBy(*kind, "block").agg(F.count("*").alias("new"))
    before = counts.select(*kind, "block", F.coalesce(F.sum("new").over(Window.partitionBy(*kind).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*kind, "block").orderBy("span_ord", "start"))
    numbered = first.withColumn("inside", inside).join(before, [*kind, "block"])
    start = F.lit(0)
    if seeds is not None:
        numbered = numbered.join(seeds.select("request_id", "start_from"), "request_id", "left")
        start = F.coalesce(F.element_at("start_from", F.col("entity_type")), F.lit(0))
    n = (start + F.col("before") + F.col("inside")).cast("int")
    mapping = numbered.select("request_id", placeholders.placeholder(F.col("entity_type"), n).alias("placeholder"), "value", "entity_type", n.alias("n"))
    labels = each.join(mapping.select("request_id", "value", "placeholder"), ["request_id", "value"]).groupBy("request_id", "span_ord").agg(F.array_sort(F.collect_list(F.struct("start", "placeholder"))).alias("_labels"))
    own = F.array(F.struct(text.alias("text"), F.col(hits).alias("hits")))
    out = spans.join(labels, ["request_id", "span_ord"], "left")
    put = F.get(placeholders.joined(placeholders.pieces(own), F.transform("_labels", lambda x: x.placeholder), F.array(F.lit(0))), F.lit(0))
    return out.withColumn("masked", F.when(F.size(hits) > 0, put).otherwise(text)).drop("_labels"), mapping


def mask_every(spans: DataFrame, hits: str, seeds: DataFrame | None = None, large: int = 10_000) -> DataFrame:
    """request_id, span_ord, path, message_idx, part_idx, nested_idx, text (masked) of every span: requests of up to `large` spans in a row
    each, larger ones by mask_large(); both ways number alike."""
    sizes = spans.groupBy("request_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > large).select(F.col("request_id").alias("_large"))
    same = spans["request_id"] == sizes["_large"]
    names = ["request_id", "span_ord", "path", "message_idx", "part_idx", "nested_idx"]
    apart, _ = mask_large(spans.join(sizes, same, "left_semi"), hits, seeds)
    whole = masked_spans(mask_requests(spans.join(sizes, same, "left_anti"), hits, seeds), changed_only=False)
    return whole.select(*names, "text").unionByName(apart.select(*names, F.col("masked").alias("text")))


def masked_spans(masked: DataFrame, changed_only: bool = True) -> DataFrame:
    """One row for each span, with its places and its masked text as text; by default those that masking changed."""
    rows = masked.select("request_id", F.explode("spans").alias("x"))
    rows = rows.filter("x.changed") if changed_only else rows
    return rows.select("request_id", "x.span_ord", "x.path", "x.message_idx", "x.part_idx", "x.nested_idx", F.col("x.masked").alias("text"))


def mask_bodies(requests: DataFrame, masked: DataFrame, dialect: str) -> DataFrame:
    """request_id, body: the requests with their masked texts. Spans stay in their request's row: exploding them would filter on them first,
    for which Spark would mask everything once more."""
    new = F.transform(F.filter("spans", lambda x: x.changed), lambda x: F.struct(*[x[k].alias(k) for k in KEYS], x.masked.alias("text")))
    return rebuilt(requests.select("request_id", "body").join(masked.select("request_id", new.alias("_spans")), "request_id", "left"), dialect)


def _one_masked(df: DataFrame, text: Column, hits: Column, resolve: Callable[[Column], Column], into: str, seeds: Column | None = None, context: Column | None = None) -> DataFrame:
    """df with its text masked as `into`, each row on its own."""
    h = fresh(df, "_hits")
    out = df.withColumn(h, hits).withColumn(h, resolve(F.col(h)))
    return placeholders.masked(out, F.array(F.struct(text.alias("text"), F.col(h).alias("hits"))), into, seeds, context).drop(h)


def mask_documents(df: DataFrame, text: str, config: Pii, whitelist: tuple | list = (), lang: Column | None = None) -> DataFrame:
    """df with masked (struct of texts and context): each row a request of one text, without any exchange."""
    return _one_masked(df, F.col(text), pii_hits(F.col(text), config, lang, whitelist), resolved_pii, "masked")


def mask_service(df: DataFrame, config: Config) -> DataFrame:
    """The plain-text service over read_texts(): personal data first, then secrets in the masked text, one numbering for both.

    Adds masked_text, context, counters, entities, language, language_fallback, and detected_language.
    """
    pii, secrets = config.pii_detection, config.secrets_detection
    wants = lambda kind: F.col("detect").isNull() | F.array_contains("detect", kind)
    lang = language.request_language(F.col("given_language"), F.col("text"), list(pii.languages), pii.fallback_language)
    out = df.withColumn("_lang", lang)
    seeds = F.coalesce("start_from", F.create_map().cast("map<string,int>"))
    first = F.when(wants("pii"), pii_hits(F.col("text"), pii, F.col("_lang.language"), config.masking.whitelist)).otherwise(no_hits())
    out = _one_masked(out, F.col("text"), first, resolved_pii, "_pii", seeds).withColumn("_text", first_text("_pii"))
    second = F.when(wants("secrets"), secret_hits(F.col("_text"), secrets)).otherwise(no_hits())
    out = _one_masked(out, F.col("_text"), second, resolved_secrets, "_all", seeds, F.col("_pii.context"))
    return out.withColumns({
        "masked_text": first_text("_all"),
        "context": F.col("_all.context"),
        "counters": placeholders.counters(F.col("_all.context"), seeds),
        "entities": placeholders.entities(F.col("_all.context")),
        "language": F.col("_lang.language"),
        "language_fallback": F.col("_lang.used_fallback"),
        "detected_language": F.col("_lang.detected"),
    }).drop("_lang", "_pii", "_text", "_all")


def mask_secrets(df: DataFrame, text: str, config: Secrets) -> DataFrame:
    """df with masked: secrets of a single text masked."""
    return _one_masked(df, F.col(text), secret_hits(F.col(text), config), resolved_secrets, "masked")


def restored_choices(choices: Column, pii: Column, secrets: Column | None = None, marker: str | None = None) -> Column:
    """Dialect A responses: every choice's string content restored; other contents as they are."""
    empty = F.create_map().cast("map<string,string>")
    text = lambda c: placeholders.restore_both(c.message.content, pii, secrets if secrets is not None else empty, marker)
    return F.transform(choices, lambda c: F.struct(c["index"].alias("index"), F.struct(c.message.role.alias("role"), text(c).alias("content")).alias("message")))


def restored_blocks(blocks: Column, pii: Column, secrets: Column | None = None, marker: str | None = None) -> Column:
    """Dialect B responses: text blocks restored, literally; other blocks as they are."""
    empty = F.create_map().cast("map<string,string>")
    text = lambda b: placeholders.restore_both(b.text, pii, secrets if secrets is not None else empty, marker)
    return F.transform(blocks, lambda b: F.struct(b.type.alias("type"), F.when(b.type == "text", text(b)).otherwise(b.text).alias("text")))
