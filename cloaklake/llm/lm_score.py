"""LM scoring: the marginal probability of a text over all segmentations into the pieces of an existing vocabulary.

The vocabulary is that of a public tokenizer, which is never trained. Its pieces get unigram weights here: the counts of the
pieces in the training words, as the tokenizer segments them, plus one. A character that no piece covers has its bytes' pieces
as one more edge, so every text has a probability. Pieces don't cross words, so a document's log10 probability is the sum over
its words of log10 of the word's marginal (log-space forward recursion over the lattice of its pieces) plus that of its end.

Plan. (1) Distinct words of each task's texts with their counts, summed by word: the one table that grows with the corpus. A
marginal is worked out once for each distinct word there. (2) The `broadcast_words` most frequent words at most (a bound that
is checked by a histogram of the counts) go to all tasks as three arrays; they cover most tokens and all hot words. The rest of a
document's words go as (row, word, count) through a shuffle join with the table, in which no key is frequent.

Base score: add-one unigram over whole words, sum of log10((c + 1) / (N + V + 1)).

Defined results: a null or empty text has one token, its end; a null doc_id is never held out and learned from; repeated rows are
learned from as often as they stand and scored alike; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import tidied, written
from .wordkernel import Words, slices, text_bytes

LN10 = float(np.log(10.0))


class Pieces:
    """Pieces of a sentencepiece model with natural-log weights; words begin with its word mark."""

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        special = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(n)]
        self.size, self.end = n, n
        self.byte_ids = {int(self.model.id_to_piece(i)[1:-1], 16): i for i in range(n) if self.model.is_byte(i)}
        self.ids = {self.model.id_to_piece(i): i for i in range(n) if not special[i] and not self.model.is_byte(i)}
        self.longest = max(map(len, self.ids))

    def weigh(self, counts: np.ndarray) -> None:
        """counts: of each piece, and at the last place of ends."""
        p = np.log(counts + 1.0) - np.log(counts.sum() + len(counts))
        self.weight = {s: float(p[i]) for s, i in self.ids.items()}
        self.byte = np.array([p[self.byte_ids[b]] for b in range(256)])
        self.end_weight = float(p[self.end])

    def marginal(self, word: str) -> float:
        """Natural log of the sum over all segmentations of the product of their pieces' weights."""
        s = self.MARK + word
        n, longest, get = len(s), self.longest, self.weight.get
        forward = [-np.inf] * (n + 1)
        forward[0] = 0.0

        for j in range(1, n + 1):
            ways = [forward[i] + w for i in range(max(0, j - longest), j) if (w := get(s[i:j])) is not None]
            if s[j - 1] not in self.weight:
                ways.append(forward[j - 1] + float(self.byte[list(s[j - 1].encode("utf-8", "replace"))].sum()))
            top = max(ways)
            forward[j] = top if len(ways) == 1 else top + log(sum([exp(x - top) for x in ways]))
        return forward[n]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n (in training rows), n_all. docs: text, train."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            parts = []
            for i, j in slices(off):
                w = Words(data, off, i, j, "space")
                if not len(w.hash):
                    continue
                own, first, place = np.unique(w.hash, return_index=True, return_inverse=True)
                weight = np.repeat(train[i:j], np.diff(w.first)).astype(np.float64)
                parts.append((own, np.bincount(place, weights=weight).astype(np.int64), np.bincount(place), w.strings(first)))
            if not parts:
                continue
            own, first, place = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            n, n_all = (np.zeros(len(own), np.int64) for _ in range(2))
            np.add.at(n, place, np.concatenate([p[1] for p in parts]))
            np.add.at(n_all, place, np.concatenate([p[2] for p in parts]))
            words = pa.concat_arrays([p[3] for p in parts]).take(pa.array(first)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(n_all)], ["word", "n", "n_all"])

    counted = docs.mapInArrow(count, "word binary, n long, n_all long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def piece_counts(words: DataFrame, path: str) -> np.ndarray:
    """Weighted counts of all pieces in the training words: as many numbers as the vocabulary has pieces."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        total = np.zeros(pieces.size, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                ids = pieces.model.encode([w.decode("utf-8", "replace") for w in part.column("word").to_pylist()], num_threads=1)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((k for x in ids for k in x), np.int64, int(size.sum()))
                total += np.bincount(flat, weights=np.repeat(part.column("n").to_numpy(), size), minlength=pieces.size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

    rows = words.filter("n > 0").select("word", "n").mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(Pieces(path).size + 1, np.int64)
    out[rows.column("piece").to_numpy()] = rows.column("n").to_numpy()
    return out


def marginals(words: DataFrame, path: str, counts: np.ndarray) -> DataFrame:
    """key (the word's hash), n, n_all and lm, log10 of the word's marginal."""
    shared = words.sparkSession.sparkContext.broadcast(counts)

    @tidied
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        pieces.weigh(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = text_bytes(batch.column("word"))
            key = Words(data, off, 0, batch.num_rows, "space").hash
            lm = np.array([pieces.marginal(w.decode("utf-8", "replace")) for w in batch.column("word").to_pylist()]) / LN10
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("n"), batch.column("n_all"), pa.array(lm)], ["key", "n", "n_all", "lm"])

    return words.mapInArrow(score, "key long, n long, n_all long, lm double")


def frequent(vocabulary: DataFrame, most: int) -> int:
    """The least count such that at most `most` words have it: by powers of two, then by ever narrower steps,
    so that the driver sees a few rows however large the corpus."""

    def first_place(place: Column, low: int) -> int:
        """The least place such that at most `most` words are there or above, among those of a count of `low` or more."""
        words = {r.place: r.words for r in vocabulary.filter(F.col("n_all") >= low).groupBy(place.alias("place")).agg(F.count("*").alias("words")).collect()}
        total = 0
        for i in sorted(words, reverse=True):
            total += words[i]
            if total > most:
                return i + 1
        return 0

    bits = first_place(F.length(F.bin("n_all")), 1)
    if not bits:
        return 1
    low, high = 1 << (bits - 2), 1 << (bits - 1)  # too many words from low on, not from high on
    while high - low > 1:
        step = -(-(high - low) // 64)
        place = first_place(F.least(F.floor((F.col("n_all") - low) / step), F.lit(64)), low)
        low, high = low + (place - 1) * step, min(high, low + place * step)
    return high


def score_documents(docs: DataFrame, vocabulary_path: str, modulus: int = 7, held: int = 2, broadcast_words: int = 1 << 19) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    words = written(word_counts(rows.select("text", (~F.col("held_out")).alias("train"))), "lm-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("v")).first()
    ends = docs.filter(~held_out).count()
    train_tokens, distinct = total.n + ends, total.v + (ends > 0)
    counts = piece_counts(words, vocabulary_path)
    counts[-1] = ends
    vocabulary = written(marginals(words, vocabulary_path, counts), "lm-vocabulary")
    pieces = Pieces(vocabulary_path)
    pieces.weigh(counts)
    least = frequent(vocabulary, broadcast_words)
    top = vocabulary.filter(F.col("n_all") >= least).toArrow()
    order = np.argsort(top.column("key").to_numpy().view(np.uint64))
    arrays = [top.column(c).to_numpy()[order] for c in ("key", "n", "lm")]
    shared = spark.sparkContext.broadcast((arrays[0].view(np.uint64), arrays[1], arrays[2]))
    base_known, lm_end = float(np.log10(ends + 1)), pieces.end_weight / LN10

    @tidied
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, lm = shared.value
        log_n, task, seen = np.log10(n + 1.0), TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = text_bytes(batch.column("text"))
            size = batch.num_rows
            tokens, known, base, model = np.ones(size, np.int64), np.full(size, int(ends > 0)), np.full(size, base_known), np.full(size, lm_end)
            rare_row, rare_key, rare_n = [], [], []
            for i, j in slices(off):
                w = Words(data, off, i, j, "space")
                if not len(w.hash):
                    continue
                row = np.repeat(np.arange(i, j), np.diff(w.first))
                tokens[i:j] += np.diff(w.first)
                k = np.searchsorted(keys, w.hash)
                k[k == len(keys)] = 0
                hit = keys[k] == w.hash if len(keys) else np.zeros(len(k), bool)
                r, k = row[hit] - i, k[hit]
                known[i:j] += np.bincount(r, weights=n[k] > 0, minlength=j - i).astype(np.int64)
                base[i:j] += np.bincount(r, weights=log_n[k], minlength=j - i)
                model[i:j] += np.bincount(r, weights=lm[k], minlength=j - i)
                row, key = row[~hit], w.hash[~hit]
                if len(row):
                    order = np.lexsort((key, row))
                    row, key = row[order], key[order]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]))
                    rare_row.append(row[new])
                    rare_key.append(key[new])
                    rare_n.append(np.diff(new, append=len(row)))
            at = np.searchsorted(np.concatenate(rare_row), np.arange(size + 1)).astype(np.int32) if rare_row else np.zeros(size + 1, np.int32)
            flat = np.concatenate(rare_key).view(np.int64) if rare_key else np.zeros(0, np.int64)
            times = np.concatenate(rare_n).astype(np.int32) if rare_n else np.zeros(0, np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (flat, times)]
            row_id = (task << 40) + seen + np.arange(size)
            seen += size
            yield pa.RecordBatch.from_arrays([pa.array(row_id), batch.column("doc_id"), batch.column("held_out"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(model), *lists], ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "keys", "times"])

    schema = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, keys array<long>, times array<int>"
    part = written(rows.mapInArrow(score, schema), "lm-rows")
    rare = part.select("row_id", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row_id", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    table = vocabulary.filter(F.col("n_all") < least).select("key", "n", "lm")
    joined = rare.join(table, "key").groupBy("row_id").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).cast("long").alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_base"),
        F.sum(F.col("times") * F.col("lm")).alias("more_model"),
    )
    out = part.drop("keys", "times").join(joined, "row_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    floor = float(np.log10(train_tokens + distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + none("more_known")).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + none("more_base") - F.col("n_tokens") * floor).alias("base_score"), (F.col("model") + none("more_model")).alias("score"),
    )
