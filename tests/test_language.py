"""The language detector: short texts, lone words, scripts, profiles from labelled rows, and the expression against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cloaklake.functions import language

SHORT = {
    "Ich liebe dich": "de", "Guten Morgen": "de", "Was machst du?": "de", "Je suis content": "fr", "Où es-tu ?": "fr", "Hola, ¿cómo estás?": "es", "gracias amigo": "es",
    "Where are you?": "en", "thanks a lot": "en", "buongiorno a tutti": "it", "onde você mora": "pt", "waar woon je": "nl", "dziękuję": "pl", "vad gör du": "sv", "Hva gjør du": "no",
    "Hvad laver du": "da", "mitä kuuluu": "fi", "com et dius": "ca", "ce faci": "ro", "привіт друже": "uk", "како си": "mk", "как дела": "ru", "τι κάνεις": "el", "ačiū": "lt",
    "你好": "zh", "こんにちは": "ja", "안녕하세요": "ko",
}
NOTHING = ["", " ", "y", "ok", "12 34", "?!", "q", "🙂🙂🙂"]


def detected(spark, texts, profiles=language.PROFILES):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.orderBy("i").select(language.raw_language(F.col("t"), profiles).alias("x")).collect()]


def test_short_texts(spark):
    found = dict(zip(SHORT, detected(spark, list(SHORT)), strict=True))
    missed = {t for t in SHORT if found[t] != SHORT[t]}
    assert len(missed) <= 2 and not missed & {"Ich liebe dich", "Guten Morgen", "Je suis content", "Hola, ¿cómo estás?"}, missed


def test_too_little_says_nothing(spark):
    assert detected(spark, [*NOTHING, None]) == [None] * (len(NOTHING) + 1)


def plain(text, profiles):
    sums = {}
    for g in language.grams_of([w for w in re.split(r"[\W\d_]+", text.lower()) if w]):
        for code, w in profiles.weights.get(g, {}).items():
            sums[code] = sums.get(code, 0) + w
    return min(sums, key=lambda c: (-sums[c], c)) if sums else None


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_equal_plain_python(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abcdeéßøåłčșжиїqzx  ") for _ in range(rng.randint(3, 25))) for _ in range(120)]
    texts = [t for t in texts if sum(c.isalpha() for c in t) >= language.LETTERS]
    words = F.filter(F.split(F.lower("t"), r"[^\p{L}]+"), lambda w: w != "")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(language.by_grams(words, language.PROFILES).alias("x"))
    assert [r.x for r in df.collect()] == [plain(t, language.PROFILES) for t in texts]


def test_profiles_from_labelled_rows(spark):
    """Learned from half of the documents, right on the other half's first words, which have too few function words to decide."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text", (F.crc32("text") % 2).alias("half"))
    profiles = language.learned(docs.filter("half = 0"), sample=200)
    assert profiles.languages == ["de", "en", "es", "fr"]
    words = F.slice(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != ""), 1, 5)
    rows = docs.filter("half = 1").select("lang", language.raw_language(F.array_join(words, " "), profiles).alias("x")).collect()
    right = {code: [r.x == r.lang for r in rows if r.lang == code] for code in profiles.languages}
    assert all(sum(x) / len(x) > 0.93 for x in right.values()), {c: sum(x) / len(x) for c, x in right.items()}


def test_a_long_text_of_any_kind(spark):
    texts = ["xqzv wkrp " * 20_000, "der die und " * 30_000, "ж" * 100_000]
    assert detected(spark, texts)[1:] == ["de", plain("ж" * 1000, language.PROFILES)]


def test_learning_from_nothing(spark):
    none = language.learned(spark.createDataFrame([], "lang string, text string"))
    assert detected(spark, ["Ich liebe dich", "the house of the king and the queen"], none) == [None, "en"]


def test_profiles_are_worked_out_when_planned(spark):
    # what a lambda function makes of a literal is worked out for each row: a map of all n-grams, each time
    plan = spark.range(1).select(language.raw_language(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and plan.count("split(") == 2  # the text in words, and a word beyond ASCII in letters


def test_weights_are_added_without_sorting(spark):
    # sorting the weights of all n-grams and stepping over them took most of a request's time
    plan = spark.range(1).select(language.by_grams(F.split(F.col("id").cast("string"), ","), language.PROFILES).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan


def test_every_language_can_win_wherever_its_sum_is_kept(spark):
    codes = [f"l{i:02d}" for i in range(2 * language.LANES + 1)]
    profiles = language.Profiles({c: {chr(0x4E00 + i): 5, "ж": 1} for i, c in enumerate(codes)})
    # beyond a block, where the sums of a lane are greatest; of equal sums the first
    texts = [w for i in range(len(codes)) for w in (chr(0x4E00 + i), chr(0x4E00 + i) * (3 * language.GRAMS + 1))] + ["ж" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(language.by_grams(F.array("t"), profiles).alias("x"))
    assert [r.x for r in df.collect()] == [c for c in codes for _ in range(2)] + [codes[0]]
