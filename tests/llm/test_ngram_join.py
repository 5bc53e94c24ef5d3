import random
import re

import pytest

from cloaklake.llm import ngram_join
from cloaklake.llm.components import components

from ..conftest import DATA


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append((i, {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()))
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = {}
    for x, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(x)
    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    for a, b in pairs:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
            top[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets)), key=str)


def joined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, set string, n int")
    return sorted(map(tuple, ngram_join.ngram_join(df, cells=1 << 16, **options).collect()), key=str)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    got = sorted(map(tuple, ngram_join.ngram_join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).collect()), key=str)
    assert got == brute(rows)


def test_near_copies_and_edges(spark):
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base, line = [word() for _ in range(120)], [word() for _ in range(30)]
    rows, i = [], 0
    for _ in range(150):
        x = list(base)
        for _ in range(rnd.randrange(6)):
            x[rnd.randrange(len(x))] = word()
        rows.append((i := i + 1, " ".join(x)))
    for n in range(0, 60, 2):
        rows.append((i := i + 1, " ".join(line + [word() for _ in range(n)])))
        rows.append((i := i + 1, " ".join([word() for _ in range(n // 4)] + line)))
    rows += [(i + 1, None), (i + 2, ""), (i + 3, " \t\n"), (i + 4, "one"), (i + 5, "ONE "), (i + 6, "one two"), (i + 7, "a a a a a a a"), (i + 8, "A A A A A"), (None, "one"), (None, "nobody else"), (i + 9, " ".join(base)), (i + 9, " ".join(base)), (i + 10, "long " * 30000)]
    assert joined(spark, rows) == brute(rows)


def test_empty(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(1, None)]) == [(1, 0, 1)]


@pytest.mark.parametrize("context", [1, 3, 4096])
def test_runs_keep_every_shared_posting(spark, context):
    rnd = random.Random(3)
    rows = sorted({(t, rnd.randrange(5, 9), g, 0) for t in range(30) for g in rnd.sample(range(50), rnd.choice([1, 1, 2, 12]))})
    rows += rows[::5]
    df = spark.createDataFrame([(t, g, n, p) for t, n, g, p in sorted(rows)], "token long, g long, n long, p long").coalesce(1).sortWithinPartitions("token", "n", "g")
    got = ngram_join.runs(df, 3, 4, 3, context).collect()
    size = {}
    for t, g in {(r[0], r[2]) for r in rows}:
        size.setdefault(t, set()).add(g)
    want = sorted((t, g) for t, gs in size.items() if len(gs) > 1 for g in gs)
    assert sorted({(r.token, r.g) for r in got}) == want
    assert all(x in size[r.token] and x != r.g for r in got for x in r.picks)
    assert any(r.picks for r in got)


def test_runs_keep_a_group_that_fills_the_context(spark):
    rows = [(1, 10, 5, 0)] * 20 + [(1, 11, 6, 0), (1, 12, 6, 0), (2, 10, 5, 0)] + [(3, 10, 5, 0)] * 20
    df = spark.createDataFrame([(t, g, n, p) for t, g, n, p in rows], "token long, g long, n long, p long").coalesce(1).sortWithinPartitions("token", "n", "g")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ngram_join.runs(df, 3, 4, 3, 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted({(r.token, r.g) for r in got}) == [(1, 10), (1, 11), (1, 12)]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(x, x + 1) for x in range(0, 40)] + [(100 + rnd.randrange(50), 100 + rnd.randrange(50)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in edges:
        top[find(a)] = find(b)
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (find(a) == find(b))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parity_never_rules_out_a_link():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n in (3, 40, 700, 6000):
        for m in (n, n + n // 3):
            for shared in (n, n // 2, 0):
                x = rnd.integers(0, 2**63, n).astype(np.uint64)
                y = np.concatenate([x[:shared], rnd.integers(0, 2**63, m - shared).astype(np.uint64)])
                assert ngram_join.parity_distance(ngram_join.parity(x), ngram_join.parity(y)) <= n + m - 2 * shared
                a, b = (ngram_join.folded(ngram_join.parity(v)).view(np.uint64) for v in (x, y))
                assert int(np.bitwise_count(a ^ b).sum()) <= n + m - 2 * shared


def test_one_row_of_each_component_stays(spark):
    a, b, c, d = (" ".join(f"{x}{n}" for n in range(20)) for x in "abcd")
    rows = [(1, a), (None, a), (None, b), (None, b), (None, b + " end"), (None, c), (2, d), (3, d), (3, "quite another text of this id"), (4, a), (5, "twice the same"), (5, "twice the same"), (None, ""), (None, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in ngram_join.without_copies(df, cells=1 << 16).collect()]
    assert sum(t in (b, b + " end") for _, t in got) == 1
    want = [(1, a), (None, c), (2, d), (3, rows[8][1]), (5, "twice the same"), (None, ""), (None, ""), (6, None)]
    assert sorted((x for x in got if x[1] not in (b, b + " end")), key=str) == sorted(want, key=str)
