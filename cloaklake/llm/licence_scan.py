"""License scan: positional rare-token index, postings intersected by relative position, key phrases verified.

The index holds the postings (template, position) of all words of the templates, and each word's document frequency over all
documents. Of the words that a file and a template share, the file's `depth` of highest inverse document frequency are looked up
(of equally rare ones first those of fewer templates, then by the word itself); each occurrence and each posting give a relative
position (place in the file less place in the template). Relative positions on which enough of these words agree are candidates;
one counts if every mandatory key phrase of the template stands, word for word, within `slack` words of where it should: found by
hash, verified by bytes.

A file is looked at only for templates whose rarest key word it has, and all of whose key words it has: no other can pass.

Two passes over the texts, no shuffle of text: the first sums document frequencies of the template words (as many numbers as
the templates have words, whatever the corpus), the second judges each file on its own. A text is cut into words as arrays.

Beside the method's labels, base phrases give base labels wherever their words stand consecutively.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are judged alike; an empty table gives
an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import licence_texts
from .shared import tidied
from .wordkernel import Words, hash_of, slices, text_bytes

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

def plain_words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


class Template:
    def __init__(self, label: str, text: str, phrases: list[str]):
        self.label, self.words = label, plain_words(text)
        self.hashes = np.array([hash_of(w) for w in self.words], np.uint64)
        self.phrases = []
        for p in map(plain_words, phrases):
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(p)] == p)
            self.phrases.append((at, self.hashes[at : at + len(p)], [w.encode() for w in p]))


class RareIndex:
    """Postings of the templates' words, by word hash, and how rare each word is."""

    def __init__(self, templates: list[Template], df: dict[int, int], depth: int):
        self.templates, self.depth = templates, depth
        words = {h: w for t in templates for h, w in zip(t.hashes.tolist(), t.words, strict=True)}
        spread: dict[int, int] = {}
        for t in templates:
            for h in set(t.hashes.tolist()):
                spread[h] = spread.get(h, 0) + 1
        self.keys = np.array(sorted(words), np.uint64)
        by_rarity = sorted(words, key=lambda h: (df.get(h, 0), spread[h], words[h]))
        place = {h: i for i, h in enumerate(by_rarity)}
        self.rank = np.array([place[h] for h in self.keys.tolist()], np.int64)
        of = {h: i for i, h in enumerate(self.keys.tolist())}
        self.postings = [{} for _ in templates]  # of each template: key to its positions
        self.gates: dict[int, list[int]] = {}  # key to the templates whose rarest key word it is
        self.required, self.anchors = [], []
        for t, x in enumerate(templates):
            for p, h in enumerate(x.hashes.tolist()):
                self.postings[t].setdefault(of[h], []).append(p)
            needed = sorted({of[h] for _, hashes, _ in x.phrases for h in hashes.tolist()}, key=lambda k: self.rank[k])
            self.gates.setdefault(needed[0], []).append(t)
            self.required.append(np.array(sorted(needed)))
            # the rarest key word and its phrase's next one are always looked up: they agree wherever the phrase stands
            phrase = next(hashes for _, hashes, _ in x.phrases if needed[0] in {of[h] for h in hashes.tolist()})
            self.anchors.append(sorted({of[h] for h in phrase.tolist()}, key=lambda k: self.rank[k])[:2])
        self.gate = np.zeros(len(self.keys), bool)
        self.gate[list(self.gates)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words of the templates stand, and which they are."""
        k = np.searchsorted(self.keys, hashes)
        k[k == len(self.keys)] = 0
        at = np.flatnonzero(self.keys[k] == hashes)
        return at, k[at]

    def judged(self, hashes: np.ndarray, word: Callable[[int], bytes], at: np.ndarray, which: np.ndarray, slack: int = 2) -> tuple[set[str], float]:
        """Labels and the best share of a template's words that stand where they should. at, which: from places(); word: the file's words."""
        have = np.zeros(len(self.keys), bool)
        have[which] = True
        labels, best = set(), 0.0
        for t in [t for k in np.flatnonzero(have & self.gate).tolist() for t in self.gates[k]]:
            if have[self.required[t]].all():
                score = self._score(t, hashes, word, at, which, have, slack)
                if score:
                    labels.add(self.templates[t].label)
                    best = max(best, score)
        return labels, best

    def _score(self, t: int, hashes: np.ndarray, word: Callable[[int], bytes], at: np.ndarray, which: np.ndarray, have: np.ndarray, slack: int) -> float:
        """The share of the template's words that stand where they should at its best verified place; 0 without one."""
        x = self.templates[t]
        rare = sorted((k for k in self.postings[t] if have[k]), key=lambda k: self.rank[k])[: self.depth]
        rare += [k for k in self.anchors[t] if k not in rare]
        need = len(self.anchors[t])
        offsets = [at[which == k] - p for k in rare for p in self.postings[t][k]]
        offset, n = np.unique(np.concatenate(offsets), return_counts=True)
        near = n.astype(np.int64)
        for d in range(1, slack + 1):  # words left out or put in shift what follows
            for o in (offset + d, offset - d):
                k = np.searchsorted(offset, o)
                k[k == len(offset)] = 0
                near += np.where(offset[k] == o, n[k], 0)
        offset = offset[near >= need]
        found = []  # for each phrase, where it stands for each offset, or -1
        for p, phrase, _ in x.phrases:
            here = np.full(len(offset), -1)
            for d in sorted(range(-slack, slack + 1), key=abs):
                start = offset + p + d
                fits = (start >= 0) & (start + len(phrase) <= len(hashes)) & (here < 0)
                for j, h in enumerate(phrase):
                    fits[fits] = hashes[start[fits] + j] == h
                here[fits] = start[fits]
            found.append(here)
        good = np.flatnonzero(np.all([f >= 0 for f in found], axis=0))
        same = np.zeros(len(good))
        for p, h in enumerate(x.hashes):
            place = offset[good] + p
            inside = (place >= 0) & (place < len(hashes))
            same[inside] += hashes[place[inside]] == h
        for g in np.argsort(-same, kind="stable").tolist():
            if all(word(int(f[good[g]]) + j) == w for f, (_, _, words) in zip(found, x.phrases, strict=True) for j, w in enumerate(words)):
                return float(same[g]) / len(x.hashes)
        return 0.0


def document_frequencies(docs: DataFrame, keys: np.ndarray) -> dict[int, int]:
    """In how many documents each key occurs: one number for each key, summed over all documents."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            for i, j in slices(off):
                w = Words(data, off, i, j, "plain")
                k = np.searchsorted(keys, w.hash)
                k[k == len(keys)] = 0
                at = np.flatnonzero(keys[k] == w.hash)
                row = np.searchsorted(w.first, at, side="right")
                total += np.bincount(np.unique(row * len(keys) + k[at]) % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], ["key", "n"])

    rows = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r.key % (1 << 64): r.n for r in rows}


def scan_licences(docs: DataFrame, base: dict[str, str] = BASE, templates: list[tuple[str, str, list[str]]] | None = None, depth: int = 6, slack: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document. templates: (label, wording,
    key phrases), by default those of licence_texts."""
    made = [Template(*t) for t in (templates if templates is not None else licence_texts.templates())]
    keys = np.unique(np.concatenate([t.hashes for t in made]))
    index = RareIndex(made, document_frequencies(docs, keys), depth)
    phrases = [(label, [w.encode() for w in plain_words(p)], [np.uint64(hash_of(w)) for w in plain_words(p)]) for p, label in base.items()]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    @tidied
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            out: list[tuple] = []
            for i, j in slices(off):
                out += _scan_rows(Words(data, off, i, j, "plain"), j - i, index, phrases, slack)
            cols = [batch.column("doc_id"), *[pa.array(list(c)) for c in zip(*out, strict=True)]] if out else None
            if cols:
                types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def _scan_rows(w: Words, n: int, index: RareIndex, phrases: list, slack: int) -> list[tuple]:
    count = np.diff(w.first)
    hits: dict[int, list[tuple[int, str]]] = {}
    for label, words, hashes in phrases:
        k = len(hashes)
        ok = w.hash[: max(0, len(w.hash) - k + 1)] == hashes[0]
        for c in range(1, k):
            ok &= w.hash[c : len(ok) + c] == hashes[c]
        for s in np.flatnonzero(ok).tolist():
            row = int(np.searchsorted(w.first, s, side="right")) - 1
            if s + k <= w.first[row + 1] and all(w.bytes_of(s + c) == words[c] for c in range(k)):
                hits.setdefault(row, []).append((s - int(w.first[row]), label))
    at, which = index.places(w.hash)
    cut = np.searchsorted(at, w.first)
    gated = np.concatenate([[0], np.cumsum(index.gate[which])])
    out = []
    for r in range(n):
        found = hits.get(r, [])
        own = {x for _, x in found}
        labels, score = set(own), 0.5 if found else 0.0
        if gated[cut[r + 1]] > gated[cut[r]]:
            a, first = slice(cut[r], cut[r + 1]), int(w.first[r])
            more, best = index.judged(w.hash[w.of_row(r)], lambda i, first=first: w.bytes_of(first + i), at[a] - first, which[a], slack)
            labels |= more
            score = max(score, best)
        places = [p for p, _ in found]
        out.append((int(count[r]), len(found), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score))
    return out
