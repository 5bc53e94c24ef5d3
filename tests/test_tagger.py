"""The tagger of persons and places: decoding against all label sequences, and names and sentences that it hasn't seen."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloaklake.functions.names import FIRST_NAMES, PLACES
from cloaklake.operators import detect, mask, tagger

OTHER = ["qui", "tho", "bran", "lys", "meg", "fen", "pol", "gri", "stu", "hel", "dun", "wick", "ing"]
HELD = [
    "Hello, I am {P} from {L}.", "Did you see {P} yesterday?", "My colleague {P} works in {L} now.", "The train to {L} was late again.", "{P} asked me to write to you.", "Wir treffen {P} in {L}.",
    "Mein Freund {P} wohnt jetzt in {L}.", "Monsieur {P} travaille à {L}.", "Je suis {P}, j'habite à {L}.", "Soy {P}, vivo en {L}.", "Sono {P} e vengo da {L}.", "The Report is on the Table.", "Danke für die Hilfe am Montag.",
]


def quality(model, examples):
    right, found, wanted = 0, 0, 0
    for text, entities in examples:
        got, want = set(model.entities(text)), set(entities)
        right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
    return right / found, right / wanted


def test_names_and_sentences_not_seen_before():
    rng = random.Random(5)
    assert not set(HELD) & set(tagger.SPEECH + tagger.PLAIN)
    examples = [tagger.spoken(rng, rng.choice(HELD), OTHER) for _ in range(800)]
    known = {w for n in FIRST_NAMES + PLACES for w in n.split()}
    assert not any(text[s:e] in known for text, es in examples for s, e, _ in es)
    precision, recall = quality(tagger.taught(), examples)
    assert precision > 0.85 and recall > 0.8, (precision, recall)


@pytest.mark.parametrize("seed", range(5))
def test_decoding_equals_the_best_of_all_sequences(seed):
    rng = np.random.default_rng(seed)
    weights, pairs = rng.normal(size=(1 << tagger.BITS, 5)), rng.normal(size=(6, 5))
    rows = [rng.integers(0, 1 << tagger.BITS, 3) for _ in range(5)]
    step = pairs + tagger.allowed()

    def total(labels):
        return sum(step[a, b] for a, b in itertools.pairwise([5, *labels])) + sum(weights[f, k].sum() for f, k in zip(rows, labels, strict=True))

    assert tagger.decoded(weights, pairs, rows) == list(max(itertools.product(range(5), repeat=5), key=total))


def test_no_entity_begins_inside():
    model = tagger.taught()
    for text in ["", " ", "...", "New York New York", "é ß Ünal", "a" * 5000, "Mr Smith\nlives in\tBerlin", "🙂 Anna 🙂"]:
        words = tagger.tokens(text)
        assert all(any(s == a for a, _, _ in words) and any(e == b for _, b, _ in words) for s, e, _ in model.entities(text))


def test_a_long_text_is_decoded_in_runs():
    model, text = tagger.taught(), "My name is Lorna Vettel and I live in Karlbo. "
    assert len(model.entities(text * 3000)) == 3000 * len(model.entities(text)) > 0


def test_fit_from_labelled_rows(spark):
    rng = random.Random(8)
    rows = [tagger.spoken(rng, rng.choice(tagger.SPEECH + tagger.PLAIN)) for _ in range(900)]
    df = spark.createDataFrame([(t, [{"start": s, "end": e, "entity_type": k} for s, e, k in es]) for t, es in rows], "text string, entities array<struct<start:int,end:int,entity_type:string>>")
    model = tagger.fit(df.unionByName(df.limit(1).select(F.repeat("text", 500).alias("text"), "entities")), sample=700)
    precision, recall = quality(model, [tagger.spoken(rng, rng.choice(tagger.SPEECH), OTHER) for _ in range(300)])
    assert precision > 0.9 and recall > 0.9
    assert tagger.fit(df.limit(0)).entities("My name is Ada.") == []


def test_hits_are_masked_like_any_other(spark):
    df = spark.createDataFrame([(1, "My name is Lorna Vettel and I live in Karlbo."), (2, None), (3, "no names here")], "id int, text string")
    rows = detect.with_model_hits(df, tagger.taught()).withColumn("hits", detect.resolved_pii(F.col("model_hits")))
    spans = rows.select(F.col("id").cast("string").alias("request_id"), F.lit(0).alias("span_ord"), F.lit("text").alias("path"), F.lit(0).alias("message_idx"), F.lit(0).alias("part_idx"), F.lit(None).cast("int").alias("nested_idx"), "text", "hits")
    got = {r.request_id: r.spans[0].masked for r in mask.mask_requests(spans, "hits").collect()}
    assert got["1"] == "My name is [[PERSON_1]] and I live in [[LOCATION_1]]." and got["3"] == "no names here"
