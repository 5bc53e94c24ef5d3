"""A language detector: function words and scripts counted, and, where those don't decide, as in short texts, character n-grams
weighed by how frequent they are in each language; with fallback to a default language.

Profiles are n-grams (one letter beyond ASCII, two, three; words framed by _) with a weight in each language that has them. They are
counted from a few sentences of each language and its function words (PROFILES), or from labelled rows (learned()). A plan holds
them as a constant, in buckets by hash.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import once
from .language_texts import TEXTS

#: Frequent words of each language that its neighbours hardly have; Chinese, Japanese and Korean go by their script instead.
WORDS: dict[str, list[str]] = {
    "en": ["the", "and", "of", "to", "is", "that", "with", "for", "this", "are"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "mit", "für", "auf"],
    "fr": ["le", "les", "des", "et", "une", "est", "dans", "pour", "que", "du"],
    "es": ["el", "los", "las", "una", "por", "para", "con", "del", "es", "y"],
    "it": ["il", "di", "che", "gli", "della", "sono", "per", "non", "con", "è"],
    "nl": ["het", "een", "van", "niet", "zijn", "voor", "met", "aan", "ook", "maar"],
    "pt": ["os", "uma", "não", "com", "para", "dos", "mais", "como", "são", "em"],
    "pl": ["nie", "jest", "się", "na", "że", "jak", "ale", "czy", "dla", "oraz"],
    "sv": ["och", "att", "det", "som", "inte", "är", "för", "på", "med", "ett"],
    "no": ["og", "ikke", "det", "som", "på", "til", "er", "med", "av", "jeg", "hva", "mye", "ble", "etter"],
    "da": ["og", "ikke", "det", "som", "til", "er", "med", "af", "jeg", "hvad", "meget", "noget", "blev", "efter"],
    "fi": ["että", "oli", "mutta", "kun", "niin", "hän", "myös", "ovat", "tämä", "kuin"],
    "ca": ["els", "amb", "és", "això", "dels", "perquè", "aquesta", "aquest", "molt", "però"],
    "ro": ["și", "este", "către", "pentru", "din", "sunt", "fost", "sau", "această", "după"],
    "hr": ["što", "koji", "koja", "nije", "kao", "ili", "biti", "također", "ovaj", "samo"],
    "sl": ["kaj", "kot", "tudi", "lahko", "vendar", "kako", "bil", "bila", "sem", "ker"],
    "lt": ["ir", "yra", "kad", "bet", "kaip", "už", "iš", "jis", "buvo", "arba"],
    "ru": ["и", "в", "не", "на", "что", "как", "это", "по", "но", "из"],
    "uk": ["і", "в", "не", "на", "що", "як", "це", "та", "до", "але"],
    "mk": ["и", "на", "во", "се", "да", "не", "од", "што", "со", "кој"],
    "el": ["και", "το", "να", "του", "η", "της", "με", "για", "που", "δεν"],
}
KANA, HAN, HANGUL = "[\u3040-\u30ff]", "[\u4e00-\u9fff]", "[\uac00-\ud7a3]"
# Fixed value: the detector's code for Norwegian against the registry's.
OVERRIDES = {"no": "nb"}


#: Sums of weights of LANES languages are kept side by side in one long, LANE bits each. A weight is 8 * ln(2001), 61, at most, so the sums
#: of GRAMS n-grams stay in their bits; more are summed in blocks.
LANES, LANE, GRAMS = 4, 15, 512


class Profiles:
    """grams, sorted by code points, and for each the weights of the languages that have it."""

    def __init__(self, counts: dict[str, dict[str, int]], top: int = 400):
        """counts: of each language its n-grams' numbers; the `top` most frequent (of equally frequent ones the first) count."""
        weights: dict[str, dict[str, int]] = {}
        for code, own in sorted(counts.items()):
            total = sum(own.values())
            for gram, n in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:top]:
                # against a gram that is seen once in 2,000
                weights.setdefault(gram, {})[code] = round(8 * math.log(1 + 2000 * n / total))
        self.weights = dict(sorted(weights.items(), key=lambda x: x[0].encode()))
        self.languages = sorted(counts)

    @cached_property
    def buckets(self) -> int:
        return max(1, len(self.weights))

    @property
    def fields(self) -> list[str]:
        return [f"s{i}" for i in range(-(-len(self.languages) // LANES))]

    def columns(self) -> Column:
        """struct: numbers (buckets, by CRC-32, of maps from n-grams to their number), and a field for each LANES languages with an array of
        their weights by that number. It is a call on a literal, which Spark works out once, when it plans; what a lambda function makes of a
        literal would be worked out for each row."""
        own: list[dict[str, int]] = [{} for _ in range(self.buckets)]
        for i, gram in enumerate(self.weights):
            own[zlib.crc32(gram.encode()) % self.buckets][gram] = i
        given: dict = {"numbers": own}
        for k, f in enumerate(self.fields):
            side = self.languages[k * LANES : (k + 1) * LANES]
            given[f] = [sum(w.get(code, 0) << i * LANE for i, code in enumerate(side)) for w in self.weights.values()]
        fields = "".join(f",{f}:array<bigint>" for f in self.fields)
        return F.from_json(F.lit(json.dumps(given, ensure_ascii=False)), f"struct<numbers:array<map<string,int>>{fields}>")


def grams_of(words: list[str]) -> Iterator[str]:
    """The n-grams of words: letters beyond ASCII, then two and three characters of the framed word."""
    for w in words:
        yield from (c for c in w if ord(c) > 127)
        for n in (2, 3):
            yield from (f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n))


def _built_in() -> Profiles:
    counts = {}
    for code, text in TEXTS.items():
        counts[code] = Counter(grams_of([w for w in re.split(r"[^\w]+|[\d_]+", text) if w]))
        counts[code].update(grams_of(WORDS[code]))
    return Profiles(counts)


PROFILES = _built_in()


def grams(words: Column, of: Callable[[Column], Column] = lambda g: g) -> Column:
    """grams_of() as an expression, or what `of` makes of each; words in lower case."""
    cut = lambda f, n: F.transform(F.sequence(F.lit(1), F.length(f) - (n - 1)), lambda i: of(F.substring(f, i, F.lit(n))))
    beyond = lambda w: F.when(F.octet_length(w) > F.length(w), F.transform(F.filter(F.split(w, ""), lambda c: F.octet_length(c) > 1), of)).otherwise(F.array())
    return F.flatten(F.transform(words, lambda w: once(F.concat(F.lit("_"), w, F.lit("_")), lambda f: F.concat(beyond(w), cut(f, 2), cut(f, 3)))))


def by_grams(words: Column, profiles: Profiles) -> Column:
    """The language of the greatest sum of weights, of equal ones the first by code; null where no n-gram is known."""

    def numbers(words: Column, p: Column) -> Column:
        # an n-gram is looked up where it is cut: what a lambda function returns is copied, and numbers are cheap to copy
        own = lambda g: F.element_at(F.get(p.numbers, F.pmod(F.crc32(g), F.lit(profiles.buckets)).cast("int")), g)
        return F.filter(grams(words, own), lambda n: n.isNotNull())

    def summed(found: Column, p: Column) -> Column:
        """An array of the sums of each block."""
        one = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda s, n: s + F.get(p[f], n))
        block = lambda xs: F.struct(*[one(xs, f).alias(f) for f in profiles.fields])
        cut_up = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / GRAMS).cast("int")), lambda b: F.slice(xs, b * GRAMS + 1, GRAMS))
        return once(found, lambda xs: F.transform(F.when(F.size(xs) <= GRAMS, F.array(xs)).otherwise(cut_up(xs)), block))

    def best(sums: Column) -> Column:
        lane = lambda x, i: F.shiftright(x[profiles.fields[i // LANES]], i % LANES * LANE).bitwiseAND(F.lit((1 << LANE) - 1))
        total = lambda i: F.aggregate(sums, F.lit(0).cast("long"), lambda s, x: s + lane(x, i))
        every = F.array(*[F.struct((-total(i)).alias("s"), F.lit(code).alias("lang")) for i, code in enumerate(profiles.languages)])
        return once(F.array_min(every), lambda x: F.when(x.s < 0, x.lang))

    if not profiles.languages:
        return F.lit(None).cast("string")

    given = F.struct(words.alias("words"), profiles.columns().alias("p"))
    return once(once(given, lambda x: summed(numbers(x.words, x.p), x.p)), best)


#: Function words decide if there are so many of one language, and at most half as many of any other.
ENOUGH = 3
#: Letters that a text has to have for its n-grams to say anything.
LETTERS = 3


def raw_language(text: Column, profiles: Profiles = PROFILES) -> Column:
    """The language of a text, null if nothing tells. Words are runs of letters.

    The language with most function words, if it has ENOUGH and twice as many as any other; else the one whose n-grams weigh most. Two
    characters of a script count as a word: Hangul for Korean, Han for Chinese, or, in a text that has kana, both for Japanese.
    """
    known = sorted({w for words in WORDS.values() for w in words})
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    wide = F.octet_length(text) > F.length(text)
    count = lambda p: F.when(wide, F.regexp_count(text, F.lit(p))).otherwise(0)
    found = once(words, lambda ws: F.struct(ws.alias("words"), F.filter(ws, lambda w: w.isin(known)).alias("known"), count(KANA).alias("kana"), count(HAN).alias("han"), count(HANGUL).alias("hangul")))
    halved = lambda n: F.floor((n + 1) / 2).cast("int")

    def ranked(x: Column) -> Column:
        counts = {code: F.size(F.filter(x.known, lambda w: w.isin(own))) for code, own in WORDS.items()}
        counts |= {"zh": F.when(x.kana == 0, halved(x.han)).otherwise(0), "ja": F.when(x.kana > 0, halved(x.kana + x.han)).otherwise(0), "ko": halved(x.hangul)}
        order = F.sort_array(F.array(*[F.struct((-n).alias("s"), F.lit(code).alias("lang")) for code, n in sorted(counts.items())]))
        return F.slice(order, 1, 2)

    def two(x: Column) -> Column:
        """The words and the two first languages; where nothing is counted, as in many short texts, all have 0."""
        none = F.array(*[F.struct(F.lit(0).alias("s"), F.lit("").alias("lang"))] * 2)
        counted = (F.size(x.known) > 0) | (x.kana + x.han + x.hangul > 0)
        return F.struct(x.words.alias("words"), F.when(counted, ranked(x)).otherwise(none).alias("order"))

    def judged(x: Column) -> Column:
        first, second = F.get(x.order, 0), F.get(x.order, 1)
        plain = first.lang.isin("zh", "ja", "ko") & (first.s < 0)  # no other language is written so
        clear = (first.s <= -ENOUGH) & (first.s <= 2 * second.s)
        letters = F.aggregate(x.words, F.lit(0), lambda s, w: s + F.length(w))
        return F.when(plain | clear, first.lang).when(letters >= LETTERS, by_grams(x.words, profiles))

    return once(once(found, two), judged)


def learned(rows: DataFrame, sample: int = 1000, top: int = 400) -> Profiles:
    """Profiles from labelled rows (lang, text): of each language the `sample` rows of smallest hash. What reaches the driver is each
    language's `top` n-grams and the sum of all; languages are expected to be few hundred at most."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    few = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    counted = few.select("lang", F.explode(words).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    counted = counted.select("lang", "n", F.explode(grams(F.array("w"))).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "g")
    kept = counted.withColumns({"r": F.row_number().over(first), "all": F.sum("n").over(Window.partitionBy("lang"))}).filter(F.col("r") <= top).collect()
    counts: dict[str, dict[str, int]] = {}
    for r in kept:
        counts.setdefault(r.lang, {})[r.g] = r.n
    for code, own in counts.items():
        rest = next(r["all"] for r in kept if r.lang == code) - sum(own.values())
        if rest:
            own[""] = rest  # what isn't kept counts in shares, but is never looked up
    return Profiles(counts, top + 1)


def detect_language(text: Column, languages: list[str], fallback: str = "en", profiles: Profiles = PROFILES) -> Column:
    """struct(language, used_fallback, detected): the detected language if it is configured, else the fallback."""
    norm = F.create_map(*[F.lit(x) for kv in OVERRIDES.items() for x in kv])

    def judge(raw: Column) -> Column:
        found = F.coalesce(F.element_at(norm, raw), raw)
        own = F.coalesce(found.isin(languages), F.lit(False))
        return answer(F.when(own, found).otherwise(fallback), ~own, found)

    nothing = answer(F.lit(fallback), F.lit(True), F.lit(None).cast("string"))
    return once(text, lambda t: F.when(F.coalesce(t, F.lit("")) == "", nothing).otherwise(once(raw_language(t, profiles), judge)))


def request_language(given: Column, text: Column, languages: list[str], fallback: str = "en") -> Column:
    """The language that a request names, where it is configured; else as detected."""
    return F.when(given.isin(languages), answer(given, F.lit(False), F.lit(None).cast("string"))).otherwise(detect_language(text, languages, fallback))


def answer(language: Column, used_fallback: Column, detected: Column) -> Column:
    return F.struct(language.alias("language"), used_fallback.alias("used_fallback"), detected.alias("detected"))
