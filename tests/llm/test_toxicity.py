"""Toxicity by compression distance: held-out accuracy, windows against a plain cut, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from cloaklake.llm import queries, toxicity

SYLLABLES = ["ba", "ne", "ro", "ti", "lu", "ka", "mo", "shi", "dre", "von", "pel", "gra"]
BAD = ["worthless", "scumbag", "pathetic", "idiotic"]


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            own = [w if rng.random() > 0.06 else rng.choice(BAD) for w in own] + [rng.choice(BAD)]
        docs.append((i, " ".join(own)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1200)
    odd = [(None, "worthless scumbag"), (5000, None), (5001, ""), (5002, "worthless pathetic idiotic scumbag " * 40_000), (5003, "x" * 300_000), (5004, "é" * 70_000)]
    extra = [(3, None), (None, 1), (4, 7), (5000, 1), (5001, 0)]
    return spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS Score"), spark.createDataFrame(labels + extra, "doc_id long, toxic int")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect() if r.doc_id is not None}
    truth = dict(corpus(1200)[1])
    held = [i for i in truth if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth) and len(held) > 200
    hit = [rows[i].predicted for i in held if truth[i]]
    wrong = [rows[i].predicted for i in held if not truth[i]]
    assert np.mean(hit) > 0.85 and np.mean(wrong) < 0.1
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    assert rows[5002].predicted == 1 and rows[5000].score == rows[5001].score


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    first = sorted(toxicity.toxicity(docs, labels).collect(), key=repr)
    assert sorted(toxicity.toxicity(docs.drop("toxic", "Score"), flipped).collect(), key=repr) == first


def test_without_labels_or_rows(spark, tables):
    docs, labels = tables
    for own, share in ((labels.limit(0), 0.0), (labels.filter("toxic = 0"), 0.0), (labels.filter("toxic = 1"), 1.0)):
        assert {r.score for r in toxicity.toxicity(docs, own).collect()} == {share}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_sample_is_bounded_whatever_ids_repeat(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "concat('same id, other words ', id, ' ', sha(CAST(id AS STRING))) AS text")
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels, sample_docs=50).count() == 3000


def plain_windows(row, width):
    """Where windows of one row start, by going through it."""
    starts = [0] if row else []
    for target in range(width, len(row), width):
        at = next((i for i in range(target, min(len(row), target + 4 * width + 1)) if row[i] in b" \t\n\v\f\r"), None)
        at = (target if at is None and target + 4 * width < len(row) else at)
        if at is None and not any(c in b" \t\n\v\f\r" for c in row[target:]):
            continue
        if at is not None and at not in starts:
            starts.append(at)
    return sorted(starts)


@pytest.mark.parametrize("seed", range(5))
def test_windows_cover_rows_and_start_at_white_space(seed):
    rng = random.Random(seed)
    rows = [bytes(rng.choice(b"abcdef   \n") for _ in range(rng.randint(0, 400))) for _ in range(30)] + [b"", b"z" * 500, b" " * 90]
    data = np.frombuffer(b"".join(rows), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    start, size, row = toxicity.windows(data, off, 20)
    assert b"".join(data[s : s + z].tobytes() for s, z in zip(start, size, strict=True)) == b"".join(rows)
    assert (size > 0).all()
    for r, text in enumerate(rows[:30]):
        assert (start[row == r] - off[r]).tolist() == plain_windows(text, 20)


def test_distances_of_slices_equal_those_of_single_windows():
    scale = toxicity.Scale(b"worthless scum pathetic " * 4 + b"the and of " * 20, b"the and of " * 20)
    ws = [b" you worthless thing", b" the and of", b"", b" pathetic", b" of of the end"]
    size = np.array([len(w) for w in ws])
    d = scale.distances(b"".join(ws), np.cumsum(size) - size, size)
    one = [len(scale.ordinary.compress(w)) - len(scale.toxic.compress(w)) if w else 0 for w in ws]
    assert d.tolist() == one and d[0] > 0 and d[1] == 0


def test_query_on_given_tables(spark):
    """Some 250 toxic documents are few to learn from: held-out ones are found far more often than others are taken for toxic."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").toxic
    rows = queries.op12_toxicity(spark, sf).toPandas()
    held = rows[rows.held_out & rows.doc_id.isin(labels.index)]
    truth = labels.reindex(held.doc_id).to_numpy()
    assert held.predicted[truth == 1].mean() > 0.3
    assert held.predicted[truth == 0].mean() < 0.06
