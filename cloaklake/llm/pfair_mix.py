"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of `block_size` units (characters, by default). With weight w, block j of a source is
released at slot floor(j / w) and due by slot ceil((j + 1) / w); each slot takes, of the blocks released, the one due first. As
the weights sum to 1, every block meets its deadline, and after any number of slots each source has been given its share to
within less than one block. Weights are taken as multiples of 1 / period, and a weight below that as one: at 2^53, as exact as
doubles are, or less, so that slots, at most blocks * period, stay below 2^62 (2^42 at 2^20 blocks). The schedule is worked out on the driver for the blocks that there are, and no slot more. There are at most `max_blocks` and one for
each source: where the input has more, blocks are larger than `block_size`, all alike. More than `max_sources` sources are an error.

Documents stand in their source in the order of a hash of doc_id. The running sum of their sizes, which gives the block, is made
of totals by (source, hash range) and sums within one range, so no task holds a whole source, however large. A document is in
the block in which it starts. Nothing is dropped or repeated: a source that has run out leaves its slots empty.

Defined results: a null source is a source of its own; a source of weight 0, or that given weights don't name, has no turns: its
rows have a block, but null slot, release and deadline, and come last in the mixed order; a null or negative size counts 0; rows
without doc_id stand by a hash of all their columns; repeated rows each have their place; an empty table gives an empty result;
all columns of the input are kept, but those named like the new ones (block, slot, release, deadline, at) are replaced.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import fresh

NEW = ["block", "slot", "release", "deadline", "at"]


def quotas(weights: list[float], period: int) -> list[int]:
    """Slots of each weight in a period: proportional, by largest remainder; one where that is none, at the largest one's expense."""
    exact = [Fraction(w) for w in weights]
    total = sum(exact)
    exact = [w * period / total for w in exact]
    out = [int(x) for x in exact]
    rest = sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))
    for i in rest[: period - sum(out)]:
        out[i] += 1
    for i in [i for i, x in enumerate(out) if not x]:
        out[i] = 1
        out[max(range(len(out)), key=out.__getitem__)] -= 1
    return out


def schedule(quota: list[int], blocks: list[int] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline) of so many blocks of each source, those of one period by default: earliest deadline first among released blocks."""
    period, blocks = sum(quota), blocks or quota
    waiting = [(0, s, 0) for s in range(len(quota))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // quota[s]), s, j))
        due, s, j = heapq.heappop(ready)
        yield slot, s, j, j * period // quota[s], due
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * period // quota[s], s, j + 1))
        slot += 1


def _turns(keys: list[str], quota: list[int], blocks: list[int], names: list[str]) -> pa.Table:
    """The schedule as a table: key, block, slot, release, deadline."""
    columns = [array("q") for _ in range(5)]
    for turn in schedule(quota, blocks):
        for c, x in zip(columns, turn, strict=True):
            c.append(x)
    slot, source, *rest = (pa.array(np.frombuffer(c, np.int64) if c else np.zeros(0, np.int64)) for c in columns)
    return pa.table([pa.array(keys, pa.string()).take(source), rest[0], slot, *rest[1:]], names)


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, size: str = "n_chars", block_size: int = 1 << 20, period: int = 1 << 53, power: float = 0.5,
    range_rows: int = 4096, broadcast_rows: int = 1_000_000, max_blocks: int = 1 << 20, max_sources: int = 100_000,
) -> DataFrame:
    """docs with block, slot, release, deadline and at (where the document starts in its block). Without weights, each source's is its size to `power`."""
    spark = docs.sparkSession
    units = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    totals = docs.groupBy("source").agg(F.sum(units).alias("units"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if not totals:
        return docs.drop(*NEW).select("*", *[F.lit(None).cast("long").alias(c) for c in NEW])
    if weights is None:
        weights = {r.source: max(1.0, float(r.units)) ** power for r in totals}
    units_of = {r.source: r.units for r in totals}
    block_size = max(block_size, -(-sum(units_of.values()) // max_blocks))
    names = sorted((s for s in units_of if weights.get(s, 0.0) > 0), key=lambda s: (s is not None, s))
    blocks = [units_of[s] // block_size + 1 for s in names]  # documents of size 0 may start where the source ends
    period = max(min(period, (1 << 62) // max(1, sum(blocks))), 4 * len(names))
    quota = quotas([weights[s] for s in names], period) if names else []
    src, rng, h, n, sum_, before, in_, key, no, slot, release, due = (fresh(docs, f"_{c}") for c in ("src", "range", "h", "units", "sum", "before", "in", "key", "no", "slot", "release", "deadline"))
    plan = spark.createDataFrame(_turns(["null" if s is None else f"={s}" for s in names], quota, blocks, [key, no, slot, release, due]))
    bits = max(0, min(20, (max(r.rows for r in totals) // range_rows).bit_length()))
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    place = F.when(F.col("doc_id").isNull(), F.xxhash64(*hashable)).otherwise(F.xxhash64("doc_id", units))
    # a null source's key differs from that of any name
    rows = docs.withColumns({n: units, h: place, src: F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))}).drop(*NEW)
    rows = rows.withColumn(rng, F.shiftright(h, 64 - bits) if bits else F.lit(0).cast("long"))
    sums = rows.groupBy(src, rng).agg(F.sum(n).alias(sum_))
    earlier = Window.partitionBy(src).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    # at most sources * 2^bits rows, about one for every range_rows documents
    offsets = sums.select(src, rng, F.coalesce(F.sum(sum_).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(src, rng).orderBy(h, "doc_id", n).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(in_, F.coalesce(F.sum(n).over(inside), F.lit(0))).join(offsets, [src, rng])
    start = F.col(before) + F.col(in_)
    placed = placed.withColumns({"block": F.floor(start / block_size), "at": start % block_size})
    plan = F.broadcast(plan) if sum(blocks) <= broadcast_rows else plan  # a row for each block
    out = placed.join(plan, (F.col(src) == F.col(key)) & (F.col("block") == F.col(no)), "left")
    own = [f"`{c}`" for c in docs.columns if c not in NEW]
    return out.select(*own, "block", F.col(slot).alias("slot"), F.col(release).alias("release"), F.col(due).alias("deadline"), "at")


def in_mixed_order(docs: DataFrame, **options: object) -> DataFrame:
    """The documents themselves, sorted by their slot over all partitions, with the columns they came with."""
    kept = {c: fresh(docs, f"_{c}") for c in docs.columns if c in NEW}  # columns named like the new ones stay as they are
    mixed = mix(docs.withColumnsRenamed(kept), **options)
    return mixed.orderBy(F.asc_nulls_last("slot"), "at", "doc_id").select(*[F.col(f"`{kept.get(c, c)}`").alias(c) for c in docs.columns])
