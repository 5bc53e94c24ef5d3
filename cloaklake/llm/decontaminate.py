"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

DataFrame functions only. Texts become lower-cased words (letters and digits); shingles are k words (an item of fewer words is
one shingle), as 64-bit hashes. A shingle weighs 1 + ln(items / items that have it), so that wording which many items share
counts less; one that no item has weighs as one that a single item has.

1. Seeds. A window without any shingle of the benchmark has similarity 0 to every item, so windows are laid only where a
   document has one: the shingles of all documents meet those of the benchmark in a broadcast hash join (beyond
   `broadcast_bytes`, in a shuffle join). Each meeting lays a window as long as the item, aligned with it.
2. Fingerprints. Each distinct window and each item gets a 64-bit SimHash of its weighted shingles.
3. Multi-index. Fingerprints fall into `blocks` blocks. Two that differ in `radius` bits at most differ in at most
   radius // blocks bits in some block; items are entered in every block under all values that near, so one equi-join
   on (block, value) finds all items within the radius of a window, and the whole distance confirms it. An item has
   thousands of entries, so both sides are dealt out by (block, value): the index never passes through the driver.
   Similar pairs can lie beyond any radius, so the same join has one block more, with shingles as values: of each set the
   heaviest ones, for as long as they and what follows have a share of `threshold` of its weight. Two sets of at least that
   similarity both have the heaviest shingle that they share among these, so no pair is left out.
4. Verification. Weighted Jaccard similarity of the two shingle sets of at least `threshold`, exactly.

Defined results: null and empty texts and items match nothing; a null doc_id or item_id is carried as null; repeated rows and
repeated windows count once; with an empty table on either side there are no matches; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import fresh, once
from .shared import scratch, written


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    first = lambda w: (F.get(w, F.lit(0)) == "").cast("int")
    last = lambda w: (F.element_at(w, -1) == "").cast("int")
    # what is split off at either end of a text is an empty word
    return once(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.slice(w, first(w) + 1, F.greatest(F.lit(0), F.size(w) - first(w) - last(w))))


def _hash(words: str, at: str, k: int) -> Column:
    return F.expr(f"xxhash64({', '.join(f'get({words}, cast({at} + {j} as int))' for j in range(k))})")


def _shingles(words: str, k: int) -> Column:
    """Distinct shingle hashes of a short word array; k words each, or all words if they are fewer."""
    whole = lambda n: F.expr(f"transform(sequence(0, size({words}) - {n}), i -> xxhash64({', '.join(f'get({words}, i + {j})' for j in range(n))}))")
    out = F.array().cast("array<bigint>")
    for n in range(1, k + 1):
        enough = F.size(words) >= n if n == k else F.size(words) == n
        out = F.when(enough, whole(n)).otherwise(out)
    return F.array_distinct(out)


def _simhash(weighted: str) -> Column:
    """SimHash of an array of (h, w): bit b is set where the weights of shingles with that bit outweigh the others."""
    vote = f"aggregate({weighted}, 0D, (s, x) -> s + if(shiftright(x.h, b) & 1 = 1, x.w, -x.w))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if({vote} > 0, shiftleft(1L, b), 0L))")


def item_table(items: DataFrame, k: int) -> DataFrame:
    """item_id, digest, size, words, shingles of the items that have words; item_id and digest tell the rows apart."""
    df = items.filter("text is not null").select("item_id", words_of(F.col("text")).alias("words")).filter("size(words) > 0").distinct()
    return df.select("item_id", F.unhex(F.md5(F.array_join("words", " "))).alias("digest"), F.size("words").alias("size"), "words", _shingles("words", k).alias("hs"))


def _bounded(df: DataFrame, size: int, most: int) -> DataFrame:
    """df, for a broadcast if its size in bytes, worked out from what was counted, allows that."""
    return F.broadcast(df) if size <= most else df


def block_values(fingerprint: str, blocks: int, radius: int) -> tuple[Column, Column]:
    """Changes of up to radius // blocks bits (to be column m), and all (block, value) that they make of a fingerprint."""
    width = 64 // blocks
    near = [sum(1 << b for b in bits) for n in range(radius // blocks + 1) for bits in combinations(range(width), n)]
    parts = [F.expr(f"transform(m, x -> struct({b} as block, (shiftrightunsigned({fingerprint}, {b * width}) & {(1 << width) - 1}L) ^ x as value))") for b in range(blocks)]
    return F.lit(near).cast("array<bigint>"), F.flatten(F.array(*parts))


#: Bytes of a broadcast row: a shingle's place or weight, an item, and of each shingle in an item's array.
PLACE, ITEM, SHINGLE = 64, 120, 40
HEAVIEST_FIRST = "array_sort(transform(x, e -> struct(-e.w as v, e.h as h)))"


def _leading(threshold: float) -> Column:
    """Of the array o, heaviest first: those that with what follows have a share of `threshold` of the weight, as (block, value) of block -1."""
    total = "aggregate(o, 0D, (s, e) -> s - e.v)"
    count = f"aggregate(o, struct(0 as n, {total} as rest), (s, e) -> struct(s.n + if(s.rest >= {threshold - 1e-9!r}D * {total}, 1, 0) as n, s.rest + e.v as rest), s -> s.n)"
    return F.expr(f"transform(slice(o, 1, {count}), e -> struct(-1 as block, e.h as value))")


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, radius: int = 15, blocks: int = 4, threshold: float = 0.75, broadcast_bytes: int = 1 << 27) -> DataFrame:
    """doc_id, item_id, similarity, first_word (where the window starts) of each document and item that it holds."""
    if 64 % blocks:
        raise ValueError("blocks must divide 64")
    # each part is a written table: plans stay small, as adaptive execution plans all of a query anew on the driver after each stage
    table = written(item_table(items, k), "items")
    number, words = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    posts = table.select("item_id", "digest", "size", F.least("size", F.lit(k)).alias("k"), F.explode("hs").alias("h"))
    weight = posts.groupBy("h").agg(F.count("*").alias("df")).select("h", (1 + F.log(F.lit(float(max(1, number))) / F.greatest(F.col("df"), F.lit(1)))).alias("w"))
    # every place of a shingle in an item gives the place of a window
    at = F.expr("explode(transform(sequence(0, size - k), i -> struct(i, case k " + " ".join(f"when {n} then xxhash64({', '.join(f'get(words, i + {j})' for j in range(n))})" for n in range(1, k + 1)) + " end as h)))")
    places = table.withColumn("k", F.least("size", F.lit(k))).select("size", "k", at.alias("x")).select("k", F.col("x.h").alias("h"), "size", F.col("x.i").alias("at")).distinct()
    places = written(places, "places")
    seeds = places.count()
    sizes = [r.k for r in places.select("k").distinct().collect()]
    # the mark tells rows of one doc_id, or without one, apart
    cut = docs.filter("text is not null").select("doc_id", F.unhex(F.md5("text")).alias("mark"), words_of(F.col("text")).alias("words"))
    windows = None
    for n in sorted(sizes):
        spread = cut.filter(F.size("words") >= n).select("doc_id", "mark", "words", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("i"))
        spread = spread.select("doc_id", "mark", "words", F.size("words").alias("length"), "i", _hash("words", "i", n).alias("h"))
        start = F.greatest(F.lit(0), F.least(F.col("i") - F.col("at"), F.col("length") - F.col("size"))).alias("start")
        of_size = places.filter(F.col("k") == n)
        if seeds * PLACE <= broadcast_bytes:  # the words stay in the row that is being looked up
            laid = spread.join(F.broadcast(of_size), "h").select("doc_id", "words", "size", start)
        else:  # only (document, place, shingle) is exchanged
            found = spread.drop("words").join(of_size, "h").select(F.col("doc_id").alias("of"), F.col("mark").alias("marked"), "size", start).distinct()
            whole = cut.dropDuplicates(["doc_id", "mark"])
            laid = found.join(whole, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("marked") == F.col("mark"))).select("doc_id", "words", "size", "start")
        laid = laid.select("doc_id", "start", F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ").alias("window"))
        windows = laid if windows is None else windows.unionByName(laid)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, similarity double, first_word long"
    if windows is None:
        return docs.sparkSession.createDataFrame([], schema)
    windows = written(windows.groupBy("doc_id", "window").agg(F.min("start").alias("start")), "windows")
    # few bytes and much to compute: dealt out over all partitions
    windows = windows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "window", "doc_id")
    shingled = windows.withColumn("ws", F.filter(F.split("window", " "), lambda x: x != "")).select("doc_id", "window", "start", F.explode(_shingles("ws", k)).alias("h"))
    default = F.lit(1.0) + F.log(F.lit(float(max(1, number))))
    small_weights = _bounded(weight, seeds * PLACE, broadcast_bytes)
    weigh = lambda df, *keys: df.join(small_weights, "h", "left").withColumn("w", F.coalesce("w", default)).groupBy(*keys).agg(F.collect_list(F.struct("h", "w")).alias("x"))
    seen = weigh(shingled, "doc_id", "window", "start").withColumn("x", F.array_sort("x")).withColumn("f", _simhash("x"))
    known = weigh(posts.select("item_id", "digest", "h"), "item_id", "digest").withColumn("x", F.array_sort("x")).withColumn("f", _simhash("x"))
    seen, known = written(seen, "seen"), written(known, "known")
    near, entered = block_values("f", blocks, radius)
    index = known.withColumn("m", near).withColumn("o", F.expr(HEAVIEST_FIRST)).withColumn("leading", _leading(threshold)).select("item_id", "digest", F.col("x").alias("y"), F.col("f").alias("g"), F.explode(F.concat(entered, "leading")).alias("e")).select("item_id", "digest", "y", "g", F.col("e.block").alias("block"), F.col("e.value").alias("value"))
    fingers = index.drop("y")
    _, own = block_values("f", blocks, 0)
    asked = seen.withColumn("m", F.lit([0]).cast("array<bigint>")).withColumn("o", F.expr(HEAVIEST_FIRST)).withColumn("leading", _leading(threshold))
    asked = asked.select("doc_id", "start", "x", "f", F.explode(F.concat(own, "leading")).alias("e")).select("doc_id", "start", "x", "f", F.col("e.block").alias("block"), F.col("e.value").alias("value"))
    within = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius
    # the further block is for what the others leave; by the hint, for Spark takes the index for no larger than the items
    close = asked.join(fingers.hint("merge"), (asked.block == fingers.block) & (asked.value == fingers.value) & ((asked.block >= 0) == within))
    pairs = close.join(_bounded(known.select(F.col("item_id").alias("own_id"), F.col("digest").alias("own"), F.col("x").alias("y")), number * ITEM + words * SHINGLE, broadcast_bytes), F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.w)
    both = total(F.filter("x", lambda e: F.array_contains(F.transform("y", lambda o: o.h), e.h)))
    similarity = both / (total("x") + total("y") - both)
    scored = pairs.select("doc_id", "item_id", "start", similarity.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b")
    out = scored.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.s")).cast("long").alias("first_word"))


def without_leaks(docs: DataFrame, items: DataFrame, broadcast_ids: int = 2_000_000, **options: object) -> DataFrame:
    """The documents that hold no item. Each row is judged by its own text, whatever other rows have its doc_id, or none."""
    digest = F.unhex(F.md5("text"))
    leak = fresh(docs, "leak")
    with scratch(docs.sparkSession) as keep:
        bad = written(find_leaks(docs.select(digest.alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
        keep(bad)
    return docs.join(_bounded(bad, bad.count(), broadcast_ids), digest == F.col(leak), "left_anti")
