import math
import random

import numpy as np
import pytest

from cloaklake.llm import ann_search

from ..conftest import DATA


def brute(rows, k=20, every=20):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = sorted((-float(np.dot(np.array(v), np.array(w))), j) for j, w in rows if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("parts", [None, 12])
def test_recall(spark, parts):
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = found(ann_search.nearest(df, parts=parts, block_rows=100 if parts else 4096))
    assert got.keys() == want.keys()
    hit = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hit >= (0.999 if parts is None else 0.9)


def test_edges(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100, [0.0, 0.0]), (120, None), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (None, [5.0, 5.0]), (200, [-1.0, -2.0]), (220, [1.0, 2.0, 3.0]), (61, [-0.0, 3.0]), (62, [0.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, part int")
    want = brute([(i, v) for i, v in rows if v is None or len(v) == 2])
    assert found(ann_search.nearest(df)) == want
    r = ann_search.nearest(df).filter("query_id = 200 and rank = 1").first()
    assert (r.vec_id, r.score) == (0, -5.0)


def test_rows_that_repeat_a_vec_id(spark):
    rnd = random.Random(3)
    vectors = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(100)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0])] * 2 + [(20, vectors[50]), (40, vectors[0])] + [(7, vectors[60])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for a, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(rows) if b != a)[:20]
            want += [(i, n + 1, j, pytest.approx(-s)) for n, (s, j) in enumerate(near)]
    got = [tuple(r) for r in ann_search.nearest(df).collect()]
    assert len(got) == len(want) and sorted(r[:3] for r in got) == sorted(r[:3] for r in want)


def test_clustered_vectors_need_few_parts(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 1, (40, 32)) * 3
    x = centre[rng.integers(0, 40, 6000)] + rng.normal(0, 0.3, (6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router = ann_search.learn(x[:4000], 20, 20, 0.95)
    assert router.probes <= 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute([(i, v) for i, v in enumerate(x.tolist())])
    got = found(ann_search.nearest(df, parts=20))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert found(ann_search.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [3.0])], schema))) == {0: [20, 1], 20: [1, 0]}
    assert ann_search.nearest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert ann_search.nearest(spark.createDataFrame([], schema)).count() == 0
