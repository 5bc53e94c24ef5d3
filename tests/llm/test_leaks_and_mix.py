import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cloaklake.llm import decontaminate, pfair_mix

from ..conftest import DATA


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w, k=5):
    return {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, items):
    """All (doc, item) with a window of the item's size at weighted Jaccard similarity of 0.75 or more."""
    made = {i: shingles(words(t)) for i, t in items if words(t)}
    size = {i: len(words(t)) for i, t in items}
    df = {}
    for s in made.values():
        for g in s:
            df[g] = df.get(g, 0) + 1
    weight = lambda s: sum(1 + math.log(len(made) / max(1, df.get(g, 1))) for g in s)
    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in made.items():
            k = min(5, size[i])
            if not {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} & s:
                continue
            for a in range(max(1, len(w) - size[i] + 1)):
                x = shingles(w[a : a + size[i]])
                sim = weight(x & s) / weight(x | s)
                if sim >= 0.75 - 1e-12 and sim > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (sim, a)
    return out


def frame(spark, rows, key):
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], f"{key} long, text string, similarity double, words string")


def test_leaks_in_documents(spark):
    docs, items = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(want) > 10 and got == set(want)


def test_leaks_near_copies_and_edges(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = [[word() for _ in range(60)] for _ in range(6)] + [["tiny", "item", "here"]]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, " ... "), (0, " ".join(texts[0]))]
    docs = []
    for i, t in enumerate(texts[:6]):
        noise = [word() for _ in range(200)]
        edited = list(t)
        edited[30] = word()
        docs += [(10 * i, " ".join(noise[:70] + t + noise[70:])), (10 * i + 1, " ".join(noise[:30] + edited + noise[30:])), (10 * i + 2, " ".join(noise)), (10 * i + 3, " ".join(t[:12] + noise))]
    docs += [(90, "A Tiny, ITEM: here!"), (91, "tiny item"), (92, None), (93, ""), (90, "A Tiny, ITEM: here!"), (94, " ".join(texts[1]).upper() + "."), (95, " ".join(texts[2][:55])), (96, "long " * 50000)]
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.find_leaks(frame(spark, docs, "doc_id"), frame(spark, items, "item_id")).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys()
    for k in (0, 1, 10, 11):
        assert got[k, k // 10] == (pytest.approx(want[k, k // 10][0]), want[k, k // 10][1])
    kept = decontaminate.without_leaks(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {d for d, _ in want})
    joined = decontaminate.find_leaks(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), broadcast_bytes=0)
    assert {(r.doc_id, r.item_id) for r in joined.collect()} == want.keys()


@pytest.mark.parametrize("radius", [3])  # most of these pairs lie beyond it
def test_leaks_near_the_threshold(spark, radius):
    rnd = random.Random(1)
    common = [f"c{n}" for n in range(12)]
    texts = [[f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30, 60))] + (common if i % 2 else []) for i in range(30)]
    docs = []
    for i, t in enumerate(texts):
        for n in (1, 2, 2, 2, 2, 2, 3, 3):
            edited = list(t)
            for at in rnd.sample(range(len(t)), n):
                edited[at] = f"x{rnd.randrange(10**6)}"
            docs.append((len(docs), " ".join(["before", "it"] + edited + ["after", "it"])))
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute(docs, items)
    assert sum(s < 0.8 for s, _ in want.values()) > 20
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), radius=radius).collect()}
    assert want.keys() <= got.keys() and all(got[p] >= s - 1e-9 for p, (s, _) in want.items())


def test_clean_rows_stay_beside_leaks_with_their_doc_id(spark):
    item, clean = (" ".join(f"{c}{n}" for n in range(30)) for c in "ab")
    docs = [(None, item), (None, clean), (None, "more " + clean), (None, None), (7, item + " more"), (7, clean), (8, clean)]
    kept = decontaminate.without_leaks(frame(spark, docs, "doc_id"), frame(spark, [(1, item)], "item_id"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((d for d in docs if item not in (d[1] or "")), key=str)


def test_leaks_of_items_that_share_their_item_id(spark):
    texts = [" ".join(f"{c}{n}" for n in range(30)) for c in "abcd"]
    items = list(zip([None, None, 3, 3], texts, strict=True))
    docs = [(i, f"before it {t} after it") for i, t in enumerate(texts)]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(frame(spark, docs, "doc_id"), frame(spark, items, "item_id")).collect()}
    assert got == {(i, items[i][0]): pytest.approx(1.0) for i in range(4)}


def test_rows_without_doc_id_keep_their_own_windows_beyond_broadcasts(spark):
    """Many rows share a doc_id, or have none: each item is found in its own text's place only, in both ways."""
    texts = [" ".join(f"{c}{n}" for n in range(30)) for c in "abc"]
    docs = [(None, "word " * i + texts[i % 3]) for i in range(12)] + [(5, "other words here " + t) for t in texts] + [(None, "nothing of these " * 5)] * 4
    both = [
        sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.first_word) for r in decontaminate.find_leaks(frame(spark, docs, "doc_id"), frame(spark, list(enumerate(texts)), "item_id"), broadcast_bytes=most).collect())
        for most in (0, 1 << 27)
    ]
    assert both[0] == both[1] and len(both[0]) == 6


def broadcasts(node):
    """Rows of each table that an executed plan has broadcast."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcasts(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcasts(node.plan())
    own = [node.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchangeExec" else []
    return own + [n for i in range(node.children().size()) for n in broadcasts(node.children().apply(i))]


def test_index_is_not_broadcast(spark):
    texts = [" ".join(f"{i}w{n}" for n in range(10)) for i in range(20)]
    docs = [(i, f"before it {t} after it") for i, t in enumerate(texts)]
    found = decontaminate.find_leaks(frame(spark, docs, "doc_id"), frame(spark, list(enumerate(texts)), "item_id"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(20)]
    sent = broadcasts(found._jdf.queryExecution().executedPlan())
    assert sent and max(sent) <= 20 * 10


def test_plan_of_leaks_is_small(spark):
    """Adaptive execution plans a whole query anew on the driver after each of its exchanges."""
    item = " ".join(f"w{n}" for n in range(30))
    found = decontaminate.find_leaks(frame(spark, [(1, f"before it {item} after it"), (2, "none of it")], "doc_id"), frame(spark, [(7, item)], "item_id"))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 7)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Aggregate") <= 2
    kept = decontaminate.without_leaks(frame(spark, [(1, item), (2, "none of it")], "doc_id"), frame(spark, [(7, item)], "item_id"))
    assert [r.doc_id for r in kept.collect()] == [2]


def test_leaks_empty(spark):
    some, none = [(1, "a b c d e f g")], []
    assert decontaminate.find_leaks(frame(spark, none, "doc_id"), frame(spark, some, "item_id")).count() == 0
    assert decontaminate.find_leaks(frame(spark, some, "doc_id"), frame(spark, none, "item_id")).count() == 0
    assert decontaminate.without_leaks(frame(spark, some, "doc_id"), frame(spark, none, "item_id")).count() == 1


def test_index_holds_all_fingerprints_within_the_radius(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(40):
        f = rnd.getrandbits(64)
        g = f
        for b in rnd.sample(range(64), 15):
            g ^= 1 << b
        rows.append((i, f - (1 << 64) * (f >> 63), g - (1 << 64) * (g >> 63)))
    df = spark.createDataFrame(rows, "i int, f long, g long")
    near, entered = decontaminate.block_values("f", 4, 15)
    _, own = decontaminate.block_values("g", 4, 0)
    left = df.withColumn("m", near).select("i", entered.alias("e"))
    right = df.selectExpr("i", "g", "array(0L) m").select("i", own.alias("o"))
    assert left.join(right, "i").selectExpr("size(array_intersect(e, o)) > 0 ok").filter("not ok").count() == 0


def test_schedule_stays_within_a_block():
    for weights in ([1, 1], [5, 3, 1, 1], [0.7, 0.1, 0.1, 0.05, 0.05], [1], [1] * 37):
        quota = pfair_mix.quotas(weights, 1000)
        assert sum(quota) == 1000
        given = [0] * len(quota)
        for slot, s, j, release, due in pfair_mix.schedule(quota):
            assert j == given[s] and release <= slot < due
            given[s] += 1
            assert all(abs(g - (slot + 1) * q / 1000) < 1 for g, q in zip(given, quota, strict=True))


def mixed(spark, rows, **options):
    df = spark.createDataFrame([(i, s, n, "x", 5) for i, s, n in rows], "doc_id long, source string, n_chars long, q string, slot int")
    return pfair_mix.mix(df, **options).collect()


@pytest.mark.parametrize("range_rows", [10, 20_000])
def test_mix(spark, range_rows):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(100)) for i in range(600)] + [(None, "c", None), (None, "c", 5), (601, "c", -3), (602, "a", 5000)]
    got = mixed(spark, rows, block_size=300, range_rows=range_rows, weights={"a": 0.5, "b": 0.3, None: 0.2})
    assert sorted((r.doc_id, r.source, r.n_chars) for r in got if r.doc_id is not None) == sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    assert len(got) == len(rows)
    for s in ("a", "b", None, "c"):
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.block, r["at"]))
        total = 0
        starts = sorted(r.block * 300 + r["at"] for r in own)
        sizes = sorted(max(0, r.n_chars or 0) for r in own)
        assert starts[0] == 0 and max(r.block * 300 + r["at"] + max(0, r.n_chars or 0) for r in own) == sum(sizes)
        for r in own:
            assert r.block * 300 + r["at"] <= sum(sizes)
            assert (r.slot, r.release, r.deadline) == (None,) * 3 if s == "c" else r.release <= r.slot < r.deadline  # c has no weight
            total += max(0, r.n_chars or 0)
    slots = {}
    for r in (r for r in got if r.source != "c"):
        assert slots.setdefault(r.slot, r.source) == r.source
    assert mixed(spark, []) == []


def test_mix_keeps_to_the_target_weights(spark):
    assert pfair_mix.quotas([0.5, 0.3, 0.15, 0.05], 1000) == [500, 300, 150, 50]
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    rows = [(i, s, 1) for i, s in enumerate(s for s, w in weights.items() for _ in range(round(w * 5000)))]
    given = dict.fromkeys(weights, 0)
    for n, r in enumerate(sorted(mixed(spark, rows, block_size=1, weights=weights), key=lambda r: r.slot)):
        assert r.slot == n
        given[r.source] += 1
        assert all(abs(given[s] - (n + 1) * w) < 1 + 1e-6 for s, w in weights.items())
    hot = [1000 / 2] + [1.0] * 1000
    quota = pfair_mix.quotas(hot, 1 << 53)
    got = pfair_mix.schedule(quota, [1000] + [1] * 1000)
    assert abs(sum(s == 0 for slot, s, *_ in got if slot < 900) - 300) < 1 + 1e-6


def test_weights_over_many_periods_zero_weight_and_bounded_blocks(spark):
    for weights in ([1 / 3] * 3, [0.0001, 0.9999]):
        quota = pfair_mix.quotas(weights, 1 << 53)
        given = [0] * len(weights)
        for slot, s, *_ in itertools.islice(pfair_mix.schedule(quota, [10**6] * len(weights)), 30_000):
            given[s] += 1
            assert all(abs(g - (slot + 1) * w) < 1 + 1e-6 for g, w in zip(given, weights, strict=True))
    rows = [(i, "abc"[i % 3], 10) for i in range(300)]
    got = mixed(spark, rows, block_size=20, weights={"a": 0.5, "b": 0.5, "c": 0.0})
    assert {r.slot for r in got if r.source == "c"} == {None} and len(got) == 300
    assert max(r.slot for r in got if r.source != "c") <= 2 * 51
    got = mixed(spark, rows, block_size=20, max_blocks=10)
    assert len(got) == 300 and len({(r.source, r.block) for r in got}) <= 10 + 3
    with pytest.raises(ValueError, match="sources"):
        mixed(spark, rows, max_sources=2)
    nulls = spark.createDataFrame([(None, "a", 5, str(i)) for i in range(200)], "doc_id long, source string, n_chars long, text string")
    got = pfair_mix.mix(nulls, block_size=50, range_rows=20).collect()
    assert len(got) == 200 and len({(r.block, r["at"]) for r in got}) == 200


def test_words_begin_with_the_first_word(spark):
    got = spark.createDataFrame([(t,) for t in ('"alpha beta"', "alpha, beta", "", "...", "x")], "t string").select(decontaminate.words_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [["alpha", "beta"], ["alpha", "beta"], [], [], ["x"]]


def test_mixed_order(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    out = pfair_mix.in_mixed_order(df, block_size=4096)
    assert out.columns == df.columns
    want = [r.doc_id for r in pfair_mix.mix(df, block_size=4096).orderBy("slot", "at", "doc_id").collect()]
    assert [r.doc_id for r in out.collect()] == want and sorted(want) == sorted(r.doc_id for r in df.collect())


@pytest.mark.parametrize(("weights", "blocks"), [([1.0, 1e-17], [3, 2000]), ([1.0, 1e-300], [1, 1 << 12]), ([0.5, 0.5, 5e-324], [9, 9, 3000])])
def test_tiny_weights_with_many_blocks(spark, weights, blocks):
    """No slot beyond 64 bits; every document has its turn, and the heavy sources theirs first."""
    docs = spark.createDataFrame([(i, f"s{k}", 10) for k, n in enumerate(blocks) for i in range(n)], "doc_id long, source string, n_chars long")
    rows = pfair_mix.mix(docs, {f"s{k}": w for k, w in enumerate(weights)}, block_size=10).collect()
    assert len(rows) == sum(blocks) and all(r.slot is not None and 0 <= r.slot <= r.deadline < 1 << 63 for r in rows)
    assert len({(r.slot, r.source, r.block) for r in rows}) == len({r.slot for r in rows})
    last = f"s{len(weights) - 1}"
    # the small source has one block at most before the others have run out
    heavy = max(r.slot for r in rows if r.source != last)
    assert len({r.block for r in rows if r.source == last and r.slot < heavy}) <= 1
