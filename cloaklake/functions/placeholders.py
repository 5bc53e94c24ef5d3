"""Numbered placeholders: masking with a context that spans of a request share, and restoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import cut, cutter, fresh, looked_up, once, scan
from .patterns import no_hits

OPEN, CLOSE = "[[", "]]"
ENTRY = "struct<placeholder:string,value:string,entity_type:string,n:int>"
CONTEXT = f"array<{ENTRY}>"
Marker = str | Callable[[Column], Column] | None


def placeholder(entity_type: Column, n: Column) -> Column:
    return F.concat(F.lit(OPEN), entity_type, F.lit("_"), n.cast("string"), F.lit(CLOSE))


def empty_context() -> Column:
    return F.array().cast(CONTEXT)


PIECES = "struct<gaps:array<string>,found:array<struct<value:string,entity_type:string>>>"


def pieces(spans: Column) -> Column:
    """Each span (text, hits) as what its hits leave (before each one, and after the last) and what they hold, cut in one pass."""

    def taken(text: Column, c: Column, hs: Column) -> Column:
        end = lambda i: F.when(i > 0, F.get(hs, i - 1).end).otherwise(0)
        before = F.transform(hs, lambda h, i: cut(c, end(i), h.start - end(i)))
        last = F.element_at(hs, -1).end
        tail = cut(c, last, F.greatest(F.lit(0), F.length(text) - last))
        return F.struct(F.array_append(before, tail).alias("gaps"), F.transform(hs, lambda h: F.struct(cut(c, h.start, h.end - h.start).alias("value"), h.entity_type.alias("entity_type"))).alias("found")).cast(PIECES)

    def one(s: Column) -> Column:
        text = F.coalesce(s.text, F.lit(""))
        whole = F.struct(F.array(text).alias("gaps"), F.array().cast("array<struct<value:string,entity_type:string>>").alias("found")).cast(PIECES)
        own = F.struct(cutter(text).alias("c"), F.sort_array(s.hits).alias("hits"))
        return F.when(F.size(s.hits) > 0, once(own, lambda x: taken(text, x.c, x.hits))).otherwise(whole)

    return F.transform(spans, one)


def all_found(p: Column) -> Column:
    """What all hits of pieces() hold, in order."""
    return F.flatten(F.transform(p, lambda x: x.found))


def extended(context: Column, found: Column, seeds: Column) -> Column:
    """The context with an entry for each value that it lacks, in the order of their first places; by sorting, not by search."""
    return once(F.struct(context.cast(CONTEXT).alias("context"), found.alias("found"), seeds.alias("seeds")), lambda x: _extended(x.context, x.found, x.seeds))


def _extended(context: Column, found: Column, seeds: Column) -> Column:
    n = F.size(context)
    both = F.concat(
        F.transform(context, lambda e, i: F.struct(e.value.alias("value"), (i - n).alias("at"), e.entity_type.alias("entity_type"))),
        F.transform(found, lambda x, i: F.struct(x.value.alias("value"), i.alias("at"), x.entity_type.alias("entity_type"))),
    )
    first = lambda r: F.filter(r, lambda x, i: (x.at >= 0) & ((i == 0) | (F.get(r, i - 1).value != x.value)))
    base = lambda t: F.coalesce(F.element_at(seeds, t), F.lit(0)) + F.size(F.filter(context, lambda e: e.entity_type == t)) + 1
    entry = lambda x, t, number: F.struct(x.at.alias("at"), placeholder(t, number).alias("placeholder"), x.value.alias("value"), t.alias("entity_type"), number.alias("n"))

    def of_type(new: Column, t: Column) -> Column:
        own = F.sort_array(F.transform(F.filter(new, lambda x: x.entity_type == t), lambda x: F.struct(x.at.alias("at"), x.value.alias("value"))))
        return once(base(t).cast("int"), lambda b: F.transform(own, lambda x, i: entry(x, t, b + i)))

    def numbered(new: Column) -> Column:
        types = F.array_distinct(F.transform(new, lambda x: x.entity_type))
        made = F.sort_array(F.flatten(F.transform(types, lambda t: of_type(new, t))))
        return F.transform(made, lambda x: F.struct(x.placeholder.alias("placeholder"), x.value.alias("value"), x.entity_type.alias("entity_type"), x.n.alias("n"))).cast(CONTEXT)

    return F.concat(context, once(once(F.sort_array(both), first), numbered))


def labels(found: Column, context: Column) -> Column:
    """The placeholder of each thing found."""
    return looked_up(F.transform(found, lambda x: x.value), F.transform(context, lambda e: F.struct(e.value.alias("k"), e.placeholder.alias("v"))))


def starts(p: Column) -> Column:
    """How many hits are before each of the pieces."""
    return scan(F.transform(p, lambda x: F.size(x.found)), F.lit(0), lambda at, n: at + n, lambda at, n: F.array(at), "array<int>").out


def joined(p: Column, own: Column, at: Column) -> Column:
    """Texts with labels in place of hits: own are all labels, at is where those of each piece begin."""
    text = lambda x, o, a: F.array_join(F.transform(x.gaps, lambda g, k: F.when(k < F.size(x.found), F.concat(g, F.get(o, a + k))).otherwise(g)), "")
    return once(F.struct(p.alias("p"), own.alias("own"), at.alias("at")), lambda y: F.transform(y.p, lambda x, i: text(x, y.own, F.get(y.at, i))))


def mask_spans(spans: Column, seeds: Column | None = None, context: Column | None = None) -> Column:
    """struct(texts: array of masked texts, context: entries in the order of their making).

    spans: array of struct(text, hits), hits resolved (no overlap). A value that the context has, of whatever type, keeps its
    placeholder; another gets the next number of its type: seed (0 without one) + entries of that type in this context + 1.
    A null text counts as an empty one, null hits as none. Work grows with the texts and n log n of their hits.
    """
    seeds = seeds if seeds is not None else F.create_map().cast("map<string,int>")
    context = context if context is not None else empty_context()
    first = F.struct(pieces(spans).alias("p"), context.cast(CONTEXT).alias("before"))
    second = lambda x: F.struct(x.p.alias("p"), all_found(x.p).alias("found"), starts(x.p).alias("at"), x.before.alias("before"))
    third = lambda x: F.struct(x.p.alias("p"), x.found.alias("found"), x.at.alias("at"), F.when(F.size(x.found) > 0, extended(x.before, x.found, seeds)).otherwise(x.before).alias("context"))
    fourth = lambda x: F.struct(x.p.alias("p"), x.at.alias("at"), x.context.alias("context"), labels(x.found, x.context).alias("own"))
    last = lambda x: F.struct(joined(x.p, x.own, x.at).alias("texts"), x.context.alias("context"))
    return once(once(once(once(first, second), third), fourth), last)


def masked(df: DataFrame, spans: Column, into: str, seeds: Column | None = None, context: Column | None = None) -> DataFrame:
    """df with mask_spans() of the spans as `into`. Its steps are columns here, which takes Spark less time to analyse."""
    seeds = seeds if seeds is not None else F.create_map().cast("map<string,int>")
    p, found, own, at, grown = (fresh(df, n) for n in ("_pieces", "_found", "_labels", "_starts", "_context"))
    out = df.withColumns({p: pieces(spans), grown: (context if context is not None else empty_context()).cast(CONTEXT)})
    out = out.withColumn(found, all_found(F.col(p)))
    some = lambda value, otherwise: F.when(F.size(found) > 0, value).otherwise(otherwise)
    # most texts have no hits, and are done with here
    out = out.withColumns({at: some(starts(F.col(p)), F.array().cast("array<int>")), grown: some(extended(F.col(grown), F.col(found), seeds), F.col(grown))})
    out = out.withColumn(own, some(labels(F.col(found), F.col(grown)), F.array().cast("array<string>")))
    texts = some(joined(F.col(p), F.col(own), F.col(at)), F.transform(p, lambda x: F.get(x.gaps, F.lit(0))))
    return out.withColumn(into, F.struct(texts.alias("texts"), F.col(grown).alias("context"))).drop(p, found, own, at, grown)


def mask_text(text: Column, hits: Column, seeds: Column | None = None, context: Column | None = None) -> Column:
    """struct(texts, context) of a single text; texts has one element."""
    return mask_spans(F.array(F.struct(text.alias("text"), hits.alias("hits"))), seeds, context)


def mapping(context: Column) -> Column:
    """placeholder to value."""
    return F.map_from_entries(F.transform(context, lambda e: F.struct(e.placeholder, e.value)))


def counters(context: Column, seeds: Column | None = None) -> Column:
    """Last number of each type: what was seeded, and what the context's entries have reached."""
    types = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda e: e.entity_type)))
    last = lambda c, t: F.array_max(F.transform(F.filter(c, lambda e: e.entity_type == t), lambda e: e.n))
    own = once(context, lambda c: F.map_from_entries(F.transform(types(c), lambda t: F.struct(t, last(c, t)))))
    return own if seeds is None else F.map_zip_with(seeds, own, lambda _, a, b: F.greatest(a, b))


def entities(context: Column, before: Column | None = None) -> Column:
    """Entries that are new since `before`: type and placeholder, by order of their type's first entry, then number."""
    none = F.array().cast("array<string>")
    old = F.transform(before, lambda e: e.placeholder) if before is not None else none
    types = F.array_distinct(F.transform(context, lambda e: e.entity_type))
    known = F.struct(context.alias("context"), old.alias("old"), types.alias("types"))
    new = lambda x: F.filter(x.context, lambda e: ~F.array_contains(x.old, e.placeholder))
    placed = lambda x: F.sort_array(F.transform(new(x), lambda e: F.struct(F.array_position(x.types, e.entity_type).alias("o"), e.n, e.entity_type, e.placeholder)))
    return F.transform(once(known, placed), lambda e: F.struct(e.entity_type.alias("type"), e.placeholder.alias("placeholder")))


MARK = r"\[\[[A-Za-z0-9_]+\]\]"
#: A bracket before or after a mark, with at most word characters between: what is put in there may make another mark of it.
CROWDED = rf"\[[A-Za-z0-9_]*{MARK}|{MARK}[A-Za-z0-9_]*\]"
#: Placeholders up to this number are replaced one after the other, which is then the quicker way.
FEW = 16


def restore(text: Column, values: Column, marker: Marker = None) -> Column:
    """text with each placeholder of the map replaced by its value, one after the other, longest placeholders first (equal lengths by
    code points), literally; marker goes before values, or, as a function of a Column, makes of each what is put in.

    Beyond FEW placeholders they are looked up in one pass, where that gives the same: all have the usual form, no value has a
    bracket, and in the text no bracket stands near a mark, so that nothing put in can be, or become part of, a placeholder.
    """
    return once(F.struct(text.alias("text"), values.alias("values")), lambda x: _restored(x["text"], x["values"], marker))


def _restored(text: Column, values: Column, marker: Marker) -> Column:
    ordered = F.sort_array(F.transform(F.map_entries(values), lambda e: F.struct((-F.length(e.key)).alias("l"), e.key.alias("k"), e.value.alias("v"))))
    value = lambda v: marker(v) if callable(marker) else F.concat(F.lit(marker), v) if marker else v
    in_turn = F.aggregate(ordered, text, lambda t, e: F.replace(t, e.k, value(e.v)))
    if callable(marker) or (marker and ("[" in marker or "]" in marker)):
        return in_turn

    def at_once(marks: Column) -> Column:
        own = looked_up(marks, F.transform(F.map_entries(values), lambda e: F.struct(e.key.alias("k"), value(e.value).alias("v"))))
        filled = lambda o: F.transform(F.split(text, MARK, -1), lambda g, i: F.when(i < F.size(marks), F.concat(g, F.coalesce(F.get(o, i), F.get(marks, i)))).otherwise(g))
        return F.array_join(once(own, filled), "")

    usual = F.forall(F.map_entries(values), lambda e: F.rlike(e.key, F.lit(f"^{MARK}$")) & ~F.rlike(e.value, F.lit(r"[\[\]]")))
    apart = (F.size(values) > FEW) & usual & ~F.rlike(text, F.lit(CROWDED))
    return F.when(apart, once(F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), at_once)).otherwise(in_turn)


def restore_both(text: Column, pii: Column, secrets: Column, marker: Marker = None) -> Column:
    """Masked secrets first, then personal data: restored in the reverse order. Secrets have no marker."""
    return restore(restore(text, pii, marker), secrets)


def partial_start(text: Column) -> Column:
    """Where the last placeholder begins that hasn't ended, or -1."""
    last = F.length(text) - F.locate(OPEN, F.reverse(text)) - F.lit(1)
    open_ = F.locate(OPEN, F.reverse(text)) > 0
    return F.when(open_ & ~F.contains(F.substring(text, last + 1, F.length(text)), F.lit(CLOSE)), last).otherwise(-1).cast("int")
