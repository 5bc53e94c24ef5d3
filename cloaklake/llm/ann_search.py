"""Approximate nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a classifier that routes.

Learning takes a bounded sample (at most `max_sample` vectors, a share of all rows by a hash): its graph of nearest neighbours
is cut into parts of nearly equal size with few edges between them, and a softmax classifier learns, for a vector, in which parts
its neighbours are. Every vector of the table is indexed, in its most probable part; a query goes to its several most probable
parts, as many as reach `target` recall on the sample. There, inner products in double precision rank all vectors.

Parts grow in number with the square root of the table's rows. A part is searched in blocks, each with all of its queries in
blocks as well, so no task holds more than a block of both; nothing is left out. Of equal vectors only the 21 with the
smallest ids can be among the 20 nearest of any query, so only those are indexed (the rest is an exact reduction: a hot vector
costs no more than others), and equal queries are searched once (two vectors of one 64-bit hash would be taken for equal there).

The sample is of distinct vectors, in the order of their hashes, so the parts don't depend on how the table lies in files. What
learning holds on the driver is the sample (`sample_bytes` at the most) and blocks of a few hundred rows by parts.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id and
vectors whose length isn't the commonest one (of equally common ones the largest); ties go to the smaller vec_id; a query never
finds its own row; rows that repeat a vec_id, with the same vector or another one, are rows of their own: each is a candidate to
the others, and each of those that are queries has its own list; with fewer candidates than k all are returned; an empty table
gives an empty result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import tidied, written


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles), h (hash) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    df = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(good, F.lit(False)))
    top = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    # adding 0.0 makes -0.0 and 0.0 one
    return df.filter(F.size("v") == (top.n if top else 0)).withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("h", F.xxhash64("v"))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


class Router:
    """The classifier: probabilities of parts, from weights and offsets."""

    def __init__(self, w: np.ndarray, b: np.ndarray, probes: int):
        self.w, self.b, self.probes = w, b, probes

    def logits(self, x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / n) @ self.w + self.b


def neighbour_graph(x: np.ndarray, k: int, rows: int = 256) -> np.ndarray:
    """The k nearest others of each row by inner product, in blocks."""
    out = np.empty((len(x), k), np.int64)
    y = x.astype(np.float32)
    for a in range(0, len(x), rows):
        s = y[a : a + rows] @ y.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + rows] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8, slack: float = 0.05, rows: int = 256) -> np.ndarray:
    """A part for each row: started from centres under a cap, then moved to where most neighbours are, while there is room."""
    n = len(x)
    cap = int(np.ceil(n / parts * (1 + slack)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(rounds):
        top = np.concatenate([(unit[a : a + rows] @ centre.T).max(1) for a in range(0, n, rows)])
        room = np.full(parts, cap)
        order = np.argsort(-top)
        for a in range(0, n, rows):
            wanted = np.argsort(-(unit[order[a : a + rows]] @ centre.T), axis=1)
            for r, w in zip(order[a : a + rows].tolist(), wanted, strict=True):
                p = int(w[np.argmax(room[w] > 0)])
                part[r], room[p] = p, room[p] - 1
        centre = np.zeros((parts, x.shape[1]))
        np.add.at(centre, part, unit)
        centre /= np.maximum(1e-12, np.linalg.norm(centre, axis=1, keepdims=True))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for r in rng.permutation(n).tolist():
            own, votes = np.unique(part[near[r]], return_counts=True)
            p = int(own[votes.argmax()])
            if p != part[r] and votes.max() > votes[own == part[r]].sum() and size[p] < cap:
                size[part[r]] -= 1
                size[p] += 1
                part[r], moved = p, moved + 1
        if not moved:
            break
    return part


def learn(x: np.ndarray, parts: int, k: int, target: float, seed: int = 11, epochs: int = 40, rows: int = 256) -> Router:
    """The graph, its cut, the classifier, and the number of parts a query is sent to."""
    n, d = x.shape
    if parts < 2 or n < 4 * parts:
        return Router(np.zeros((d, 1)), np.zeros(1), 1)
    rng = np.random.default_rng(seed)
    near = neighbour_graph(x, min(k, n - 1))
    part = balanced_parts(x, near, parts, rng)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    w, b = rng.normal(0, 0.01, (d, parts)), np.zeros(parts)
    m, v, t = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)], 0
    for epoch in range(epochs):
        rate = 0.1 * (1 - epoch / epochs)
        for some in np.array_split(rng.permutation(n), max(1, n // rows)):
            want = np.zeros((len(some), parts))  # half the own part, half those of the neighbours
            np.add.at(want, (np.repeat(np.arange(len(some)), near.shape[1]), part[near[some]].ravel()), 0.5 / near.shape[1])
            want[np.arange(len(some)), part[some]] += 0.5
            z = unit[some] @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - want) / len(some)
            t += 1
            for i, (value, grad) in enumerate(((w, unit[some].T @ g), (b, g.sum(0)))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                value -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    home = np.concatenate([(unit[a : a + rows] @ w + b).argmax(1) for a in range(0, n, rows)])
    reached = []  # which probe finds each true neighbour
    for a in range(0, n, rows):
        order = np.argsort(-(unit[a : a + rows] @ w + b), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(order), 0), 1)
        reached.append(np.take_along_axis(place, home[near[a : a + rows]], 1).ravel())
    reached = np.sort(np.concatenate(reached))
    probes = int(reached[min(len(reached) - 1, int(np.ceil(target * len(reached))))]) + 1
    return Router(w, b, probes)


def best(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query, vec_id, score of the k largest inner products of each query, ties to the smaller vec_id; whether the vectors are the same."""
    got: list[tuple] = []
    for a in range(0, len(q), 512):
        part = q[a : a + 512]
        s = part @ c.T
        if s.shape[1] > k:
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            slack = 1e-9 * np.maximum(1.0, np.abs(s).max(1))
            row, col = np.nonzero(s >= (least - slack)[:, None])
        else:
            row, col = (x.ravel() for x in np.indices(s.shape))
        exact = np.zeros(len(row))  # one order of summation for all, the plain one, so that equal vectors tie
        for d in range(c.shape[1]):
            exact += part[row, d] * c[col, d]
        order = np.lexsort((c_id[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        row, col = row[keep], col[keep]
        got.append((q_id[a:][row], c_id[col], exact[keep], (part[row] == c[col]).all(1)))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, max_sample: int = 65_536, sample_bytes: int = 1 << 27, target: float = 0.95, block_rows: int = 4096, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    parts = parts or max(1, min(int(total**0.5) // 16, max_sample // 64))
    router = Router(np.zeros((1, 1)), np.zeros(1), 1)
    if parts > 1:
        size = min(max_sample, max(8192, 64 * parts), max(1, sample_bytes // (8 * len(rows.first().v))), total)
        share = rows.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, 1.1 * size / total) * (1 << 30)))
        # of equal vectors one is enough to learn from
        sample = share.groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(size)
        router = learn(matrix(sample.select("v").toArrow().column("v")), parts, k, target)
    shared = spark.sparkContext.broadcast(router)

    def routed(probes: int):
        @tidied
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = shared.value
            for batch in batches:
                x = matrix(batch.column("v"))
                if r.w.shape[1] == 1 or not len(x):
                    found = np.zeros((len(x), 1), np.int32)
                else:
                    found = np.argsort(-r.logits(x), axis=1, kind="stable")[:, :probes].astype(np.int32)
                off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(off, pa.array(found.ravel()))], ["vec_id", "v", "parts"])

        return work

    order = Window.partitionBy("h", "v").orderBy("vec_id")
    kept = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select("vec_id", "v")
    columns = "vec_id long, v array<double>, parts array<int>"
    index = written(kept.mapInArrow(routed(1), columns).select("vec_id", "v", F.col("parts")[0].alias("part")), "ann-index")
    queries = rows.filter(F.col("vec_id") % every == 0)
    # a vector is asked for once, under its hash
    distinct = queries.groupBy("h").agg(F.min("v").alias("v")).select(F.col("h").alias("vec_id"), "v")
    asked = written(distinct.mapInArrow(routed(router.probes), columns).select("vec_id", "v", F.explode("parts").alias("part")), "ann-queries")
    blocks = index.groupBy("part").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    q_blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / block_rows).alias("q_blocks"))
    plan = F.broadcast(blocks.join(q_blocks, "part"))  # a row for each part
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    c = index.join(plan, "part").select("part", at("blocks").alias("block"), upto("q_blocks").alias("q_block"), "vec_id", "v")
    q = asked.join(plan, "part").select("part", at("q_blocks").alias("q_block"), upto("blocks").alias("block"), "vec_id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "same": pa.array([], pa.bool_())})
        found = best(left.column("vec_id").to_numpy(), matrix(left.column("v")), right.column("vec_id").to_numpy(), matrix(right.column("v")), k + 1)
        return pa.table(dict(zip(("q", "vec_id", "score", "same"), map(pa.array, found), strict=True)))

    keys = ["part", "block", "q_block"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, "q long, vec_id long, score double, same boolean")
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "vec_id", "score", "same"))), 1, k + 1)
    lists = found.groupBy("q").agg(ranked.alias("found"))
    out = queries.select(F.col("vec_id").alias("query_id"), "h").join(lists, F.col("h") == F.col("q"))
    # one of the rows with the query's vec_id and vector is its own; where more than k have the vector, it may be none of these
    out = out.withColumn("own", F.array_position(F.transform("found", lambda x: x.same & (x.vec_id == F.col("query_id"))), True))
    own = F.slice(F.filter("found", lambda _, i: i + 1 != F.col("own")), 1, k)
    return out.select("query_id", F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
