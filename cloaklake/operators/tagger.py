"""Persons and places by a trained sequence tagger: an averaged perceptron over hashed features, with Viterbi decoding.

A text is cut into tokens (words, and other characters one by one). Each token's features are its word, shape, beginning and end, those
of its neighbours, and whether a list has it; a table of weights, by feature hash and label, and one of label pairs score a sequence of
labels (O, B- and I- of each type), of which the best is found by Viterbi's recursion. No list is needed to find a name: what
stands around it and how it is written decides.

fit() learns on the driver from a bounded sample of labelled texts; taught() learns from sentences that a rule makes (patterns of
speech in five languages, names made of syllables), for where there are no labelled texts. A Tagger is a model for
detect.with_model_hits(), which runs it in Arrow batches; it holds its weights only (2^15 x 5 numbers), so a broadcast is small.
Long texts are decoded in runs of tokens cut at sentence ends, so work grows with the text.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import FIRST_NAMES, PLACES, TITLES

TYPES = ("PERSON", "LOCATION")
LABELS = ["O", *[f"{p}-{t}" for t in TYPES for p in "BI"]]
BITS = 15
#: The score of a model's hit, beyond the usual threshold.
SCORE = 0.85
#: Tokens that are decoded at once, at most.
RUN = 400
_TOKEN = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*|\d+|[^\w\s]|_")
_LISTED = {w.lower(): "first" for w in FIRST_NAMES} | {w.lower(): "place" for p in PLACES for w in p.split()} | {w.lower(): "title" for w in TITLES}
Entity = tuple[int, int, str]


def tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]


def shape(word: str) -> str:
    if not word[0].isalpha():
        return "9" if word[0].isdigit() else word[0]
    return "X" if len(word) == 1 and word.isupper() else "XX" if word.isupper() else "Xx" if word[0].isupper() else "x"


def features(words: list[str]) -> list[np.ndarray]:
    """For each word the hashes of its features."""
    low, form = [w.lower() for w in words], [shape(w) for w in words]
    at = lambda xs, i: xs[i] if 0 <= i < len(xs) else "|"
    out = []
    for i, w in enumerate(low):
        before, after = at(low, i - 1), at(low, i + 1)
        own = (
            "b", f"w{w}", f"f{form[i]}", f"e{w[-3:]}", f"e{w[-2:]}", f"s{w[:3]}", f"l{_LISTED.get(w)}", f"p{before}", f"n{after}", f"pp{at(low, i - 2)} {before}",
            f"pf{before}{form[i]}", f"nf{form[i]}{after}", f"ff{at(form, i - 1)}{form[i]}{at(form, i + 1)}", f"lp{_LISTED.get(before)}{form[i]}", f"2{at(low, i - 2)}{form[i]}", f"3{form[i]}{at(low, i + 2)}",
        )
        out.append(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in own]))
    return out


class Tagger:
    """texts to lists of (start, end, type, score)."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights.astype(np.float32), pairs.astype(np.float32)

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        return [[(s, e, t, SCORE) for s, e, t in self.entities(text)] for text in texts]

    def entities(self, text: str) -> list[Entity]:
        out: list[Entity] = []
        for run in runs(tokens(text)):
            labels = decoded(self.weights, self.pairs, features([w for _, _, w in run]))
            out += joined(run, labels)
        return out


def runs(found: list[tuple[int, int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """Tokens in runs that end with a sentence, or after RUN tokens."""
    own: list[tuple[int, int, str]] = []
    for t in found:
        own.append(t)
        if len(own) >= RUN or (t[2] in ".!?" and len(own) >= RUN // 8):
            yield own
            own = []
    if own:
        yield own


def joined(run: list[tuple[int, int, str]], labels: list[int]) -> list[Entity]:
    out: list[Entity] = []
    for (s, e, _), k in zip(run, labels, strict=True):
        name = LABELS[k]
        if name.startswith("I-") and out and out[-1][2] == name[2:]:
            out[-1] = (out[-1][0], e, name[2:])
        elif name != "O":
            out.append((s, e, name[2:]))
    return out


def allowed() -> np.ndarray:
    """0 where a label may follow another, else minus infinity; the last row is for a sequence's start."""
    out = np.zeros((len(LABELS) + 1, len(LABELS)))
    for j, b in enumerate(LABELS):
        for i, a in enumerate([*LABELS, "O"]):
            if b.startswith("I-") and a[2:] != b[2:]:
                out[i, j] = -np.inf
    return out


_ALLOWED = allowed()


def decoded(weights: np.ndarray, pairs: np.ndarray, rows: list[np.ndarray]) -> list[int]:
    """The labels of the greatest sum (Viterbi)."""
    step = pairs + _ALLOWED
    score, back = None, []
    for f in rows:
        own = weights[f].sum(0)
        if score is None:
            score = step[-1] + own
            continue
        total = score[:, None] + step[:-1]
        back.append(total.argmax(0))
        score = total.max(0) + own
    if score is None:
        return []
    labels = [int(score.argmax())]
    for b in reversed(back):
        labels.append(int(b[labels[-1]]))
    return labels[::-1]


def labelled(text: str, entities: Iterable[Entity]) -> tuple[list[str], list[int]]:
    """Words and labels of a text; an entity is what tokens it covers."""
    found = tokens(text)
    labels = ["O"] * len(found)
    for s, e, kind in entities:
        own = [i for i, (a, b, _) in enumerate(found) if s <= a and b <= e]
        if kind in TYPES:
            for n, i in enumerate(own):
                labels[i] = f"{'I' if n else 'B'}-{kind}"
    return [w for _, _, w in found], [LABELS.index(x) for x in labels]


def learn(examples: list[tuple[str, list[Entity]]], rounds: int = 5, seed: int = 7) -> Tagger:
    """An averaged perceptron: for each example decoded wrongly, weights go towards its labels and away from those found."""
    data = []
    for text, entities in examples:
        words, gold = labelled(text, entities)
        if words:
            data.append((features(words), gold))
    weights, pairs = np.zeros((1 << BITS, len(LABELS))), np.zeros((len(LABELS) + 1, len(LABELS)))
    sums, pair_sums, n = np.zeros_like(weights), np.zeros_like(pairs), 1
    rng = random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(data)
        for rows, gold in data:
            found = decoded(weights, pairs, rows)
            if found != gold:
                for labels, sign in ((gold, 1.0), (found, -1.0)):
                    before = len(LABELS)
                    for f, k in zip(rows, labels, strict=True):
                        np.add.at(weights[:, k], f, sign)
                        np.add.at(sums[:, k], f, sign * n)
                        pairs[before, k] += sign
                        pair_sums[before, k] += sign * n
                        before = k
            n += 1
    return Tagger(weights - sums / n, pairs - pair_sums / n)


def fit(rows: DataFrame, sample: int = 2000, longest: int = 2000, rounds: int = 5) -> Tagger:
    """A tagger from labelled rows (text, entities: array of struct(start, end, entity_type)). The sample is the `sample` rows of smallest
    hash among texts of at most `longest` characters: these bounds are what the driver holds."""
    few = rows.filter(F.length("text") <= longest).select("text", "entities").orderBy(F.xxhash64("text"), "text").limit(sample).collect()
    return learn([(r.text, [(e.start, e.end, e.entity_type) for e in r.entities or []]) for r in few], rounds)


# Sentences made by rule: {P} a person, {L} a place ------------------------------------------------------------------------

SPEECH = [
    "My name is {P}.", "I am {P} and I live in {L}.", "Please call {P} tomorrow.", "{P} lives in {L}.", "Dear {P}, thank you for your letter.", "We met Mr {P} in {L} last week.", "She moved from {L} to {L}.",
    "The meeting with {P} is on Monday.", "Send the parcel to {P}, {L}.", "{P} said that the Report was late.", "Have you ever been to {L}?", "Our Office in {L} is closed.", "Ask Dr. {P} about it.", "This was written by {P}.",
    "Ich heiße {P}.", "Mein Name ist {P} und ich wohne in {L}.", "Herr {P} kommt aus {L}.", "Wir fahren morgen nach {L}.", "Das Haus von {P} steht in {L}.", "Bitte ruf Frau {P} an.", "{P} hat gesagt, dass die Arbeit gut ist.",
    "Je m'appelle {P}.", "Madame {P} habite à {L}.", "Nous allons de {L} à {L}.", "Mon ami {P} vient de {L}.", "Monsieur {P} a dit que oui.", "Il travaille à {L} depuis lundi.",
    "Me llamo {P} y vivo en {L}.", "El señor {P} es de {L}.", "Viajamos a {L} con {P}.", "Mi amigo {P} trabaja en {L}.", "La señora {P} dijo que no.",
    "Mi chiamo {P} e abito a {L}.", "Il signor {P} viene da {L}.", "Andiamo a {L} con {P}.", "La signora {P} ha detto di sì.",
]
PLAIN = [
    "The Weather is nice today.", "Please send me the Report on Friday.", "Thank you very much!", "What is the price of the new Phone?", "The Meeting starts at 9.", "We use Python and Excel in our Office.", "Yes, No, Maybe.",
    "Das Wetter ist heute schön.", "Bitte schicken Sie mir den Bericht am Montag.", "Die Katze und der Hund schlafen im Garten.", "Guten Morgen, wie geht es Ihnen?", "Der Computer ist kaputt.",
    "Il fait beau aujourd'hui.", "Merci beaucoup pour votre Lettre.", "La réunion commence à midi.", "Hace buen tiempo hoy.", "Gracias por todo, hasta Mañana.", "La casa es muy grande.", "Oggi è una bella giornata.", "Grazie mille, a Domani.",
]
SYLLABLES = ["ba", "bel", "cor", "da", "dre", "el", "fa", "gar", "ha", "il", "jo", "ka", "lor", "ma", "mi", "na", "nor", "o", "pe", "ra", "ri", "sa", "sen", "ta", "to", "u", "va", "wen", "ya", "zo"]


def made_up(rng: random.Random, syllables: list[str] = SYLLABLES) -> str:
    return "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))).capitalize()


def spoken(rng: random.Random, pattern: str, syllables: list[str] = SYLLABLES) -> tuple[str, list[Entity]]:
    """A sentence of the pattern with names made up, and where they stand."""
    text, entities = "", []
    for piece in re.split(r"(\{[PL]\})", pattern):
        if piece in ("{P}", "{L}"):
            n = rng.choice([1, 2, 2]) if piece == "{P}" else rng.choice([1, 1, 1, 2])
            name = " ".join(made_up(rng, syllables) for _ in range(n))
            entities.append((len(text), len(text) + len(name), "PERSON" if piece == "{P}" else "LOCATION"))
            text += name
        else:
            text += piece
    return text, entities


@lru_cache(maxsize=1)
def taught(sentences: int = 1500, seed: int = 3) -> Tagger:
    """A tagger that has learned from sentences made by rule; the same each time."""
    rng = random.Random(seed)
    return learn([spoken(rng, rng.choice(SPEECH if k % 4 else PLAIN)) for k in range(sentences)], rounds=4)
