"""The source audit against plain Python, with runs, pieces and flushes as small as they go."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cloaklake.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, least=3, ranks=4):
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t in df if df[t] >= least}
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if t in kept)
        v = len(kept)
        share = lambda c, n: {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * v) for t in kept}
        whole = sum(counts.values(), Counter())
        q = share(whole, sum(whole.values()))
        p = {s: share(c, sum(c.values())) for s, c in counts.items()}
        for s in p:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, i.decode(), -value, rank) for part, own in (("pair", pairs), ("term", terms)) for rank, (value, i) in enumerate(own, 1)]
    return sorted(out)


def rows(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "Été", "straße", "日本", "a", "zz", "naïve", "dog"]
    return [
        (None if rng.random() < 0.05 else rng.choice(["", " 12 ", *[rng.choice([" ", "3", "\n", "’"]).join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(6)]]), rng.choice([None, "", "en", "en", "de"]), rng.choice([None, "a", "a", "a", "b", "Ä", "z"]))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("seed", "flush", "piece"), [(1, 400_000, 1 << 22), (2, 5, 16), (3, 1, 1)])
def test_equals_plain_python(spark, seed, flush, piece):
    data = rows(seed, 120)
    df = spark.createDataFrame(data, "text string, lang string, source string").repartition(5).selectExpr("*", "1 AS term", "2 AS N", "3 AS value")
    got = sorted(map(tuple, source_audit.audit(df, min_docs=3, ranks=4, flush_rows=flush, piece_bytes=piece).collect()))
    assert got == expected(data)


def test_no_kept_terms_and_empty_tables(spark):
    data = [("x y", "en", "a"), (None, "en", "b"), ("7", "de", None), ("", "fr", "only")]
    df = spark.createDataFrame(data, "text string, lang string, source string")
    assert sorted(map(tuple, source_audit.audit(df).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert source_audit.audit(df.limit(0)).collect() == []


def test_a_very_long_text_and_a_hot_term(spark):
    data = [("hot " * 200_000 + "end", "en", "a")] + [("hot cold", "en", s) for s in "ab" * 40]
    df = spark.createDataFrame(data, "text string, lang string, source string").repartition(4)
    got = sorted(map(tuple, source_audit.audit(df, min_docs=30, ranks=50, flush_rows=10, piece_bytes=10_000).collect()))
    assert got == expected(data, 30, 50)


def test_pieces_are_cut_between_terms():
    text = "ab cd, efgh ij" * 20
    for size in (1, 3, 50, 1000):
        own = [p for _, p in source_audit.pieces([text, "", "x" * 99], size)]
        assert "".join(own) == text + "x" * 99
        assert [t for p in own for t in TERM.findall(p)] == TERM.findall(text) + ["x" * 99]
