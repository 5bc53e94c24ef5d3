"""Resolution of overlapping hits within arrays, by sorting and folds. Touching intervals don't overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once, scan
from .patterns import HIT

INTERVAL = "struct<start:int,end:int,entity_type:string,score:double>"


def overlaps(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def _hit(start: Column, end: Column, entity_type: Column, score: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), entity_type.alias("entity_type"), score.alias("score"))


def _own(h: Column) -> Column:
    return _hit(h.start, h.end, h.entity_type, h.score)


def _some(value: Column) -> Column:
    """An array of the value, or an empty one for null."""
    return F.filter(F.array(value), lambda x: x.isNotNull())


def _unless_apart(hits: Column, ordered: Column, resolve: Callable[[], Column]) -> Column:
    """Hits that don't overlap, as most don't, stay as they are, in order; else what resolve makes of them."""
    apart = lambda o: F.forall(F.transform(o, lambda h, i: F.coalesce(F.get(o, i - 1).end <= h.start, F.lit(True))), lambda x: x)
    return F.when(F.size(hits) <= 1, hits.cast(HIT)).otherwise(once(ordered, lambda o: F.when(apart(o), o).otherwise(resolve())))


def merge_same_type(hits: Column) -> Column:
    """Overlapping hits of one type become one, over all of them, with the best score; transitively."""
    by_type = F.sort_array(F.transform(hits, lambda h: F.struct(h.entity_type, h.start, h.end, h.score)))
    meets = lambda last, h: F.coalesce((last.entity_type == h.entity_type) & (h.start < last.end), F.lit(False))
    joined = lambda last, h: _hit(last.start, F.greatest(last.end, h.end), last.entity_type, F.greatest(last.score, h.score))
    state_of = lambda last, h: F.when(meets(last, h), joined(last, h)).otherwise(_own(h))
    out_of = lambda last, h: F.when(meets(last, h), F.array().cast(HIT)).otherwise(_some(last))
    return once(scan(by_type, F.lit(None).cast(INTERVAL), state_of, out_of, HIT), lambda s: F.concat(s.out, _some(s.state)))


def resolve_by_score(hits: Column) -> Column:
    """After merging: by score, then length, then start (then type), each kept if it overlaps none kept; in order of start."""
    return once(hits, _by_score)


def _best_of(hits: Column) -> Column:
    """The choice among hits that hang together."""
    ranked = F.sort_array(F.transform(hits, lambda h: F.struct((-h.score).alias("s"), (h.start - h.end).alias("l"), h.start, h.entity_type, h.end)))

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda k: (k.start < x.end) & (x.start < k.end)), acc).otherwise(F.array_append(acc, _hit(x.start, x.end, x.entity_type, -x.s)))

    return F.when(F.size(hits) <= 1, hits.cast(HIT)).otherwise(F.aggregate(ranked, F.array().cast(HIT), step))


def _by_score(hits: Column) -> Column:
    # hits that overlap, also by way of others, form an island; what is kept in one doesn't touch another
    ordered = F.sort_array(merge_same_type(hits))
    grown = lambda last, h: F.struct(F.greatest(last.end, h.end).alias("end"), F.array_append(last.hits, h).alias("hits"))
    alone = lambda h: F.struct(h.end.alias("end"), F.array(h).alias("hits"))
    state_of = lambda last, h: F.when(h.start < last.end, grown(last, h)).otherwise(alone(h))
    out_of = lambda last, h: F.when((h.start < last.end) | (F.size(last.hits) == 0), F.array().cast(f"array<{HIT}>")).otherwise(F.array(last.hits))
    begin = F.struct(F.lit(-1).alias("end"), F.array().cast(HIT).alias("hits"))
    islands = once(scan(ordered, begin, state_of, out_of, f"array<{HIT}>"), lambda s: F.array_append(s.out, s.state.hits))
    kept = F.sort_array(F.flatten(F.transform(islands, _best_of)))
    return _unless_apart(hits, F.sort_array(F.transform(hits, _own)).cast(HIT), lambda: kept)


def resolve_by_start(hits: Column) -> Column:
    """By start, then longest first (then type); each kept if it starts where the last kept one has ended."""
    return once(hits, _by_start)


def _by_start(hits: Column) -> Column:
    ranked = F.sort_array(F.transform(hits, lambda h: F.struct(h.start, (h.start - h.end).alias("l"), h.entity_type, h.end, h.score)))

    state_of = lambda last, x: F.when(x.start >= last, x.end).otherwise(last)
    out_of = lambda last, x: F.when(x.start >= last, F.array(_own(x))).otherwise(F.array().cast(HIT))
    return _unless_apart(hits, F.sort_array(F.transform(hits, _own)).cast(HIT), lambda: scan(ranked, F.lit(-1), state_of, out_of, HIT).out)
