"""N-gram Jaccard join: grouped prefix join over the sets of distinct word shingles of whole texts.

1. Sets. Each text becomes its set of distinct k-word shingles, as sorted 64-bit hashes (with fewer than k words, the whole
   sequence is the one shingle). Texts with equal sets are one class (a 128-bit digest of the set); each task also adds up how
   many sets have a shingle, in a sketch of `cells` counters. Sketch counts only order the shingles: any fixed order gives the
   same links, a good one (rare shingles first) gives few candidates.
2. Prefixes. Sets with Jaccard similarity of at least t share a shingle among the first n - ceil(t n) + 1 of each. Sets with the
   same prefix and the same size are one group, which stands for its members in all postings (shingle, group, size, place).
3. Picks. In each run of equal shingles every group picks up to `picks` earlier groups of fitting size at random (by a hash).
   Picks are so many times the postings at most, and join the many copies of one text without writing out their pairs.
4. Verification. Each set has a parity bitmap: two sets differ in at least as many shingles as their bitmaps in bits, which
   rules out most pairs that don't link, and no other; of the rest, the shingles that two sets share are counted, exactly.
   Verified links give components.
5. The rest. What picks haven't joined is compared in full: in each run that still holds several components, every group outside
   the run's largest component meets all groups of other components that pass the size, positional and bitmap filters; so does
   every pair of members of a group that are in different components. These pairs are verified as well. A link is lost only if
   its ends are in one component already.

Texts are read three or four times, and only sets that are in candidate pairs leave the tasks that read them (a Bloom filter of
bounded size; what it lets through by mistake is joined away). No step gathers a group in one task's memory: runs stream through
with at most `context` postings held, and joins are equi-joins that adaptive execution can split.

Hash collisions: two shingles of 64 bits within one pair of texts, or two sets of 128 bits in the corpus.

Defined results: a text that is null, empty or without words has an empty set, n_shingles 0, and its own doc_id as component; a
null doc_id takes part, but never names a component (a component of null ids alone has null); repeated rows are linked like
other equal texts; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import fresh
from .components import components
from .shared import scratch, tidied, written
from .wordkernel import U64, Words, mixed, shingles, slices, text_bytes

CHUNK = 1 << 16


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Row, sorted distinct shingles and 128-bit digest of each text that has words."""
    data, off = text_bytes(batch.column("text"))
    for i, j in slices(off):
        w = Words(data, off, i, j, "space")
        for r in range(j - i):
            s = shingles(w, r, k)
            if len(s):
                yield i + r, s, xxhash.xxh3_128_digest(s.tobytes())


def _lists(arrays: list[np.ndarray], dtype: type = np.int64) -> pa.Array:
    n = np.fromiter(map(len, arrays), np.int32, len(arrays))
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(arrays).view(dtype) if arrays else np.zeros(0, dtype)))


def features(docs: DataFrame, k: int, cells: int) -> DataFrame:
    """Rows (doc_id, own, n, set) of all texts, and rows (chunk, counts) with each task's part of the sketch; own is as in docs."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "own", "n", "set", "chunk", "counts"]
        total, seen = np.zeros(cells, np.uint8), set()
        for batch in batches:
            n, digest, new, held = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [], 0

            def add(new: list[np.ndarray]) -> None:
                if new:
                    own, times = np.unique(np.concatenate(new) & U64(cells - 1), return_counts=True)
                    at = own.astype(np.int64)
                    total[at] = np.minimum(255, total[at].astype(np.int64) + times)

            for row, s, d in shingle_sets(batch, k):
                n[row], digest[row] = len(s), d
                if d not in seen:
                    seen.add(d)
                    new.append(s)
                    held += len(s)
                    if held > 1 << 20:
                        add(new)
                        new, held = [], 0
            add(new)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), pa.array(n), pa.array(digest, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        parts = total.reshape(-1, CHUNK)
        at = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array([parts[c].tobytes() for c in at], pa.binary())], names)

    schema = "doc_id long, own binary, n long, set binary, chunk int, counts binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "own", "text").mapInArrow(work, schema)


def sketch_levels(parts: DataFrame, cells: int) -> np.ndarray:
    """The tasks' sketches added up, as logarithmic levels: `cells` bytes, whatever the input."""

    @tidied
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(x.as_buffer(), np.uint8)
                total[c] = total[c] + part if c in total else part.astype(np.int64)
        level = [(4 * np.log2(np.maximum(1, t))).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], ["chunk", "levels"])

    out = np.zeros(cells, np.uint8)
    for r in parts.repartition(8, "chunk").mapInArrow(add, "chunk int, levels binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.levels, np.uint8)
    return out


def parity(s: np.ndarray) -> bytes:
    """Bit b is the parity of the number of shingles that fall on b; some 2 to 4 bits for each shingle, within bounds."""
    bits = 1 << min(13, max(9, (2 * len(s) - 1).bit_length()))
    at = ((s >> U64(32)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


FOLDS = ["f0", "f1", "f2", "f3"]


def folded(bits: bytes) -> np.ndarray:
    """A parity bitmap folded to 256 bits: four integers that joins can compare."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > 32:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.int64)


def parity_distance(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ, the longer one folded to the shorter one's size."""
    x, y = sorted((x, y), key=len)
    y = np.frombuffer(y, np.uint8)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ y).sum())


def prefixes(docs: DataFrame, k: int, levels: np.ndarray, num: int, den: int) -> DataFrame:
    """set, its group (a hash of prefix and size), size n, parity bitmap, prefix tokens, rare ones first; a set once for each task."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        mask = U64(len(level) - 1)
        for batch in batches:
            rows: list[tuple] = []
            for _, s, d in shingle_sets(batch, k):
                if d in seen:
                    continue
                seen.add(d)
                n = len(s)
                p = s[np.argsort(level[(s & mask).astype(np.int64)], kind="stable")[: n - (num * n + den - 1) // den + 1]]
                rows.append((d, xxhash.xxh3_64_intdigest(p.tobytes(), seed=n), n, parity(s), p))
            if rows:
                d, g, n, b, p = zip(*rows, strict=True)
                folds = np.array([folded(x) for x in b]).T
                columns = [pa.array(d, pa.binary()), pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(b, pa.binary()), *map(pa.array, folds), _lists(list(p))]
                yield pa.RecordBatch.from_arrays(columns, ["set", "g", "n", "bits", *FOLDS, "tokens"])

    return docs.select("text").mapInArrow(work, f"set binary, g long, n long, bits binary, {', '.join(f'{f} long' for f in FOLDS)}, tokens array<long>")


def runs(postings: DataFrame, num: int, den: int, picks: int = 4, context: int = 4096) -> DataFrame:
    """Postings whose token at least one other group has, each with picks: earlier groups of its run that may be similar.

    postings: token, g, n, p, sorted by (token, n, g) within partitions that hold tokens whole.
    """
    columns = ["token", "g", "n", "p"]

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int64)] * 4
        held, before = none, none  # held: the last run so far; before: the latest of its postings that went out already

        def out(ready: list[np.ndarray], before: list[np.ndarray]) -> pa.RecordBatch:
            c = len(before[0])
            token, g, n, p = (np.concatenate(x) for x in zip(before, ready, strict=True))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (g[1:] != g[:-1])
            token, g, n, p, own = token[new], g[new], n[new], p[new], (np.arange(len(new)) >= c)[new]
            start = np.ones(len(token), bool)
            start[1:] = token[1:] != token[:-1]
            run = np.cumsum(start) - 1
            keep = np.bincount(run, minlength=1)[run] > 1
            token, g, n, p, own, run = token[keep], g[keep], n[keep], p[keep], own[keep], run[keep]
            order = run * (1 << 40) + n
            first = np.searchsorted(order, run * (1 << 40) + (num * n + den - 1) // den)
            width = np.arange(len(token)) - first
            first, width = first[own], width[own]
            mine = [x[own] for x in (token, g, n, p)]
            seed = mixed((mine[0] ^ mine[1]).view(U64))[:, None] + np.arange(picks, dtype=U64)[None, :]
            pick = first[:, None] + (mixed(seed) % np.maximum(width, 1).astype(U64)[:, None]).astype(np.int64)
            pick[:, 1:][np.arange(1, picks)[None, :] >= width[:, None]] = 0  # no more picks than there are groups
            near = (np.arange(picks)[None, :] < width[:, None]) & ((num + den) * np.minimum((mine[2] - mine[3])[:, None], (n - p)[pick]) >= num * (mine[2][:, None] + n[pick]))
            off = np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32)
            got = pa.ListArray.from_arrays(pa.array(off), pa.array(g[pick[near]]))
            return pa.RecordBatch.from_arrays([*map(pa.array, mine), got], [*columns, "picks"])

        for batch in batches:
            if not batch.num_rows:
                continue
            both = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, columns, strict=True)]
            new = np.ones(len(both[0]), bool)  # a group once in each run, so a run that exceeds the context has several groups
            new[1:] = (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1])
            both = [x[new] for x in both]
            cut = int(np.searchsorted(both[0], both[0][-1]))
            if len(before[0]) and before[0][-1] != both[0][0]:
                before = none
            if cut:
                yield out([x[:cut] for x in both], before)
                before, held = none, [x[cut:] for x in both]
            else:
                held = both
            if len(held[0]) > context:
                yield out(held, before)
                before, held = [x[-context:] for x in held], none
        if len(held[0]):
            yield out(held, before if len(before[0]) and before[0][-1] == held[0][0] else none)

    return postings.mapInArrow(work, "token long, g long, n long, p long, picks array<long>")


def bloom(keys: DataFrame, count: int, most: int = 1 << 26) -> np.ndarray:
    """Bits of a one-hash filter of the sets: 16 for each, `most` at the most, so at most 8 MB."""
    bits = 1 << min(most.bit_length() - 1, max(16, (16 * count).bit_length()))
    at = F.pmod(F.xxhash64("set"), F.lit(bits))
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(set), {bits}) % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def may_link(pairs: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """The distinct pairs (a, b), a < b, that the parity bitmaps in signs (set, n, bits) don't rule out; a written table."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            apart = np.fromiter(map(parity_distance, x, y), np.int64, len(x))
            keep = (num + den) * apart <= (den - num) * (batch.column("m").to_numpy() + batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, "candidates")
    pairs = pairs.join(signs.select(F.col("set").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x")), "a")
    pairs = pairs.join(signs.select(F.col("set").alias("b"), "n", F.col("bits").alias("y")), "b")
    return written(pairs.select("a", "b", "m", "n", "x", "y").mapInArrow(work, "a binary, b binary"), "pairs")


def verified(docs: DataFrame, pairs: DataFrame, signs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of sets with shared * den >= num * union; a written table."""
    spark = docs.sparkSession
    pairs = may_link(pairs, signs, num, den)
    keys = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    count = keys.count()
    if not count:
        return pairs
    shared = spark.sparkContext.broadcast(bloom(keys, count))

    @tidied
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            size = 0
            for _, s, d in shingle_sets(batch, k):
                h = xxhash.xxh64_intdigest(d, seed=42) & (64 * len(bits) - 1)
                if int(bits[h >> 6]) >> (h & 63) & 1 and d not in seen:
                    seen.add(d)
                    found.append((d, s.tobytes()))
                    size += s.nbytes
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["set", "shingles"])
                        found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["set", "shingles"])

    sets = docs.select("text").mapInArrow(wanted, "set binary, shingles binary").join(keys, "set", "left_semi")
    sets = written(sets.dropDuplicates(["set"]), "pair-sets")

    @tidied
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * den >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    a = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
    out = written(a.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(linked, "a binary, b binary"), "links")
    return out


def rest_of_pairs(picked: DataFrame, members: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that share a prefix shingle or a group and pass the filters."""
    placed = members.join(label.withColumnRenamed("node", "set"), "set", "left").select("set", "g", F.coalesce("label", "set").alias("label"), *FOLDS)
    placed = written(placed, "placed")
    lone = F.min("label") == F.max("label")
    # a group of one set has that set's bitmap; of several, none, and passes
    groups = placed.groupBy("g").agg(F.when(lone, F.min("label")).alias("comp"), *[F.when(F.count("*") == 1, F.min(f)).alias(f) for f in FOLDS])
    own = F.coalesce("comp", F.encode(F.concat(F.lit("mixed group "), F.col("g").cast("string")), "utf-8"))
    entries = written(picked.drop("picks").join(groups, "g").withColumn("comp", own), "entries")
    sizes = entries.groupBy("token", "comp").agg(F.count("*").alias("c"))
    several = sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.count("*").alias("comps")).filter("comps > 1").drop("comps")
    several = written(several, "several")
    live = entries.join(several, "token")
    x = live.filter(F.col("comp") != F.col("most")).select("token", *[F.col(c).alias(f"x_{c}") for c in ("g", "n", "p", "comp", *FOLDS)])
    y = live.select("token", *[F.col(c).alias(f"y_{c}") for c in ("g", "n", "p", "comp", *FOLDS)], (F.col("comp") == F.col("most")).alias("big"))
    fits = F.expr(
        f"x_comp <> y_comp and (big or x_g < y_g) and {den} * least(x_n, y_n) >= {num} * greatest(x_n, y_n)"
        f" and {num + den} * least(x_n - x_p, y_n - y_p) >= {num} * (x_n + y_n)"
        f" and coalesce({num + den} * ({' + '.join(f'bit_count(x_{f} ^ y_{f})' for f in FOLDS)}) <= {den - num} * (x_n + y_n), true)"
    )
    met = x.join(y, "token").filter(fits).select("x_g", "y_g").distinct()
    side = lambda s: placed.select(F.col("g").alias(f"{s}_g"), F.col("set").alias(s), F.col("label").alias(f"{s}_label"))
    across = met.join(side("x"), "x_g").join(side("y"), "y_g").filter("x_label <> y_label").select(F.col("x").alias("a"), F.col("y").alias("b"))
    mixed_groups = placed.join(groups.filter(F.col("comp").isNull()).select("g"), "g")
    within = mixed_groups.select("g", F.col("set").alias("a"), F.col("label").alias("la")).join(mixed_groups.select("g", F.col("set").alias("b"), F.col("label").alias("lb")), "g")
    return across.unionByName(within.filter("a < b and la <> lb").select("a", "b"))


def _classes(docs: DataFrame, k: int, num: int, den: int, cells: int, picks: int) -> tuple[DataFrame, DataFrame]:
    """The features of all texts, and for each set the label and the component_id of its class."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(features(docs, k, cells), "features")
    levels = sketch_levels(found.filter(F.col("chunk").isNotNull()).select("chunk", "counts"), cells)
    rows = found.filter(F.col("chunk").isNull()).select("doc_id", "n", "set")
    prefix = written(prefixes(docs, k, levels, num, den), "prefixes")
    # each is read several times; and plans stay small, as adaptive execution plans all of a query anew on the driver after each stage
    members = written(prefix.select("set", "g", *FOLDS).distinct(), "members")
    signs = written(prefix.select("set", "n", "bits").distinct(), "signs")
    first = written(members.groupBy("g").agg(F.min("set").alias("rep")), "groups")
    postings = prefix.select("g", "n", F.posexplode("tokens").alias("p", "token")).select("token", "g", "n", F.col("p").cast("long").alias("p"))
    picked = written(runs(postings.repartition(parts, "token").sortWithinPartitions("token", "n", "g"), num, den, picks), "runs")
    chosen = picked.select("g", F.explode("picks").alias("pick")).distinct()
    pairs = chosen.join(first.select("g", F.col("rep").alias("a")), "g").join(first.select(F.col("g").alias("pick"), F.col("rep").alias("b")), "pick").select("a", "b")
    inside = members.select("set", "g").join(first, "g").filter("set <> rep").select(F.col("set").alias("a"), F.col("rep").alias("b"))
    links = verified(docs, pairs.unionByName(inside), signs, k, num, den)
    joined = components(links)
    more = verified(docs, rest_of_pairs(picked, members, joined, num, den), signs, k, num, den)
    # what the links have joined is given by one edge for each set, to its label
    label = components(joined.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    classes = rows.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    named = classes.join(label.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return found, written(named.join(names, "label").select("set", "label", "component_id"), "classes")


def _labelled(docs: DataFrame, k: int = 5, num: int = 3, den: int = 4, cells: int = 1 << 22, picks: int = 4) -> DataFrame:
    """doc_id, own, n, set of every document (doc_id, own, text), with the label and component_id of its set."""
    with scratch(docs.sparkSession) as keep:
        found, of_set = _classes(docs, k, num, den, cells, picks)
        keep(found, of_set)
    return found.filter(F.col("chunk").isNull()).select("doc_id", "own", "n", "set").join(of_set, "set", "left")


def ngram_join(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; texts link at Jaccard similarity num / den or more."""
    out = _labelled(docs.select("doc_id", F.lit(None).cast("binary").alias("own"), "text"), **options)
    own = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def without_copies(docs: DataFrame, broadcast_ids: int = 2_000_000, **options: object) -> DataFrame:
    """One document of each component, that of the smallest doc_id; of rows that repeat a doc_id with one text, one.

    Each row is judged by its own text, whatever other rows have its doc_id. Rows without doc_id come last in their component;
    where several are first, the digest of doc_id and text decides. Rows without words and doc_id all stay.
    """
    own = F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "text")))  # null text: no space
    found = written(_labelled(docs.select("doc_id", own.alias("own"), "text"), **options).select("doc_id", "own", "label"), "copies")
    rows = found.groupBy("label", "doc_id", "own").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own"))
    stay = found.filter("label is not null").groupBy("label").agg(first["own"].alias("own")).select("own")
    gone = written(found.filter("label is not null").select("own").distinct().join(stay, "own", "left_anti"), "gone")
    bounded = lambda df: F.broadcast(df) if df.count() <= broadcast_ids else df
    name = fresh(docs, "_own")
    out = docs.join(bounded(gone.withColumnRenamed("own", name)), own == F.col(name), "left_anti")
    again = rows.filter("times > 1 and (label is not null or doc_id is not null)").select("own").join(gone, "own", "left_anti")
    again = written(again.withColumnRenamed("own", name), "again")
    if not again.take(1):
        return out
    again = bounded(again)
    one = out.join(again, own == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, own == F.col(name), "left_anti").unionByName(one)
