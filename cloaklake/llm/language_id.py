"""Language ID: known words by log frequency in each language, unseen words by ever shorter character n-grams.

Learning uses a sample of labelled rows (documented bounds, so that the model is small however large the corpus, its texts and the
number of its languages): of each of the `max_languages` commonest languages the `sample_docs` rows of smallest hash, all where there
are fewer; of a sampled text longer than sample_bytes / sampled rows, a piece of that length at a place given by its hash. The model is a table of words and, for n = `longest` down to 1, of character n-grams, with a log frequency for each language;
it is broadcast.

A document's score for a language is the sum over its words: of a word seen in learning, its smoothed log frequency; of an
unseen word, the log frequencies of its n-grams of the greatest n of which any is known. The language of the largest sum
wins; `score` is its softmax share. Prediction reads the text alone, in one pass without a shuffle.

Words are runs of digits, letters and bytes beyond ASCII, with A-Z lower-cased; words without a letter don't count.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the language of more learning rows,
then the first by name; without any learning row every text is `und`; a null doc_id is never held out nor learned from;
repeated rows are judged alike; an empty table gives an empty result; columns other than doc_id, text, lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import tidied
from .wordkernel import Words, mixed, slices, step_powers, text_bytes

UNKNOWN = "und"
_HAS_LETTER = np.zeros(256, bool)
_HAS_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def wordy(w: Words) -> np.ndarray:
    """Which words have a letter (or a byte beyond ASCII)."""
    if not len(w.start):
        return np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(_HAS_LETTER[w.low])])
    return total[w.end] > total[w.start]


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def grams(words: list[str], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n = longest down to 1: the hashes of all n-grams of the words, framed by ^ and $, and to which word each belongs."""
    framed = [f"^{w}$" for w in words]
    length = np.fromiter(map(len, framed), np.int64, len(framed))
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(framed)), length)
    step = step_powers(longest)
    code = mixed(code + np.uint64(1))
    for n in range(longest, 0, -1):
        if len(code) < n:
            continue
        h = code[: len(code) - n + 1].copy()
        for k in range(1, n):
            h += code[k : len(code) - n + 1 + k] * step[k]
        whole = owner[: len(h)] == owner[n - 1 :]
        yield n, mixed(h[whole]), owner[: len(h)][whole]


class Model:
    """Sorted hashes with a row of log frequencies for each language: tables[0] words, tables[n] n-grams."""

    def __init__(self, languages: list[str], rows: list[int], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], longest: int, smooth: float = 0.5):
        self.languages, self.longest = languages, longest
        self.prior = np.log(np.maximum(1, rows) / max(1, sum(rows)))
        self.tables = {}
        for n, (keys, lang, count) in counts.items():
            own, place = np.unique(keys, return_inverse=True)
            m = np.zeros((len(own), len(languages)))
            np.add.at(m, (place, lang), count)
            self.tables[n] = own, np.log((m + smooth) / (m.sum(0) + smooth * (len(own) + 1)))

    def find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the rows of those that are."""
        own = self.tables[n][0] if n in self.tables else np.zeros(0, np.uint64)
        if not len(own):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        k = np.searchsorted(own, keys)
        k[k == len(own)] = 0
        known = own[k] == keys
        return known, k[known]

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that aren't in the word table."""
        out = np.zeros((len(words), len(self.languages)))
        left = np.ones(len(words), bool)
        if words:
            for n, keys, owner in grams(words, self.longest):
                known, rows = self.find(n, keys)
                use = left[owner[known]]
                np.add.at(out, owner[known][use], self.tables[n][1][rows[use]]) if len(rows) else None
                left[owner[known]] = False
                if not left.any():
                    break
        return out

    def scores(self, w: Words, rows: int) -> np.ndarray:
        """The sums for each row and language."""
        keep = np.flatnonzero(wordy(w))
        row = np.searchsorted(w.first, keep, side="right") - 1
        known, at = self.find(0, w.hash[keep])
        total = np.tile(self.prior, (rows, 1))
        if len(at):
            table = self.tables[0][1]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row[known], weights=table[at, k], minlength=rows)
        new = keep[~known]
        if len(new):
            _, first, place = np.unique(w.hash[new], return_index=True, return_inverse=True)
            own = self.unseen([b.decode("utf-8", "replace") for b in w.strings(new[first]).to_pylist()])
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row[~known], weights=own[place, k], minlength=rows)
        return total


def sampled(rows: DataFrame, sample_docs: int, piece: int) -> DataFrame:
    """lang and text, or a piece of it, of the sample_docs rows of each language whose hashes are the smallest. rows: lang, doc_id, text."""
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    first = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample_docs)
    # what a language's last sampled hash is, is found without texts; rows alike beyond it are cut by rank
    last = first(rows.select("lang", "h")).groupBy(F.col("lang").alias("own")).agg(F.max("h").alias("last"))
    few = first(rows.join(F.broadcast(last), (F.col("lang") == F.col("own")) & (F.col("h") <= F.col("last"))).select("lang", "text", "h"))
    size = F.length("text")
    return few.select("lang", F.when(size > piece, F.substring("text", F.pmod("h", size - piece + 1).cast("int") + 1, F.lit(piece))).otherwise(F.col("text")).alias("text"))


def learn(docs: DataFrame, sample_docs: int = 500, longest: int = 5, modulus: int = 5, max_languages: int = 250, sample_bytes: int = 1 << 25) -> Model:
    """A model from sample_docs rows of each language, among rows that aren't held out and have a language."""
    rows = docs.filter(F.col("lang").isNotNull() & (fold(modulus) != 0))
    commonest = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    sizes = {r.lang: r.n for r in commonest}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Model([], [], {}, longest)
    sample = sampled(rows.filter(F.col("lang").isin(languages)), sample_docs, max(64, sample_bytes // sum(min(n, sample_docs) for n in sizes.values())))
    place = {k: i for i, k in enumerate(languages)}

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for i, j in slices(off):
                w = Words(data, off, i, j, "plain")
                keep = np.flatnonzero(wordy(w))
                of = lang[i + np.searchsorted(w.first, keep, side="right") - 1]
                for k in np.unique(of).tolist():
                    own, first, n = np.unique(w.hash[keep[of == k]], return_index=True, return_counts=True)
                    yield _counted(0, own, k, n)
                    words = [b.decode("utf-8", "replace") for b in w.strings(keep[of == k][first]).to_pylist()]
                    for order, keys, owner in grams(words, longest):
                        gram, at = np.unique(keys, return_inverse=True)
                        yield _counted(order, gram, k, np.bincount(at, weights=n[owner]).astype(np.int64))

    counted = sample.select("text", "lang").mapInArrow(count, "n int, key long, lang int, count long")
    found = counted.groupBy("n", "key", "lang").agg(F.sum("count").alias("count")).toArrow()
    n, key, lang, number = (found.column(c).to_numpy() for c in ("n", "key", "lang", "count"))
    tables = {int(k): (key[n == k].view(np.uint64), lang[n == k], number[n == k]) for k in np.unique(n)}
    return Model(languages, [sizes[k] for k in languages], tables, longest)


def _counted(n: int, keys: np.ndarray, lang: int, count: np.ndarray) -> pa.RecordBatch:
    k = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, n, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.full(k, lang, np.int32)), pa.array(count)], ["n", "key", "lang", "count"])


def identify(docs: DataFrame, model: Model, carry: dict[str, Column] | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, the columns of carry, the text if it is to be kept, lang_pred and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = carry or {}

    @tidied
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = [*m.languages, UNKNOWN]
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = text_bytes(batch.column("text"))
            best, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            if m.languages:
                for i, j in slices(off):
                    w = Words(data, off, i, j, "plain")
                    s = m.scores(w, j - i)
                    p = np.exp(s - s.max(1, keepdims=True))
                    ascii_letter = np.concatenate([[0], np.cumsum((w.low >= 0x61) & (w.low <= 0x7A))])
                    o = off[i : j + 1] - off[i]
                    plain = ascii_letter[o[1:]] > ascii_letter[o[:-1]]
                    for r in range(j - i):
                        if plain[r] or has_letter(w.low[o[r] : o[r + 1]].tobytes()):
                            best[i + r] = s[r].argmax()
                            score[i + r] = p[r].max() / p[r].sum()
            keep = [x for x in batch.schema.names if keep_text or x != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in keep], pa.array([names[b] for b in best.tolist()]), pa.array(score)], names=[*keep, "lang_pred", "score"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in carry.items()], "text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in (df if keep_text else df.drop("text")).schema.fields)
    return df.mapInArrow(predict, f"{fields}lang_pred string, score double")


def language_id(docs: DataFrame, sample_docs: int = 500, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = learn(docs, sample_docs, modulus=modulus)
    return identify(docs, model, {"held_out": F.coalesce(fold(modulus) == 0, F.lit(False))})
