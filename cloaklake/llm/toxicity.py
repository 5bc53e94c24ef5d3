"""Toxicity by compression distance: windows of a text compressed with a zstandard dictionary of toxic and one of ordinary text.

A text is cut at white space into windows of about `width` bytes (A-Z lower-cased). A window's distance is how many bytes
shorter the toxic dictionary makes it. From its windows' distances a document gets a few numbers (largest, means of the greatest,
mean, shares at least at some thresholds, number of windows), and a logistic calibration turns those into the score.

Learning uses a bounded sample: of each label at most `sample_docs` rows, those of the smallest hashes, and of each row at most
`sample_windows` windows, spread over it. By a hash of the text, three eighths of the rows each are two folds for dictionaries, and
two eighths calibrate, so equal texts never are on both sides. Each dictionary is trained from distinct windows (copies of a text count
once): a part that both share, of ordinary text and of those ordinary windows which seemed most toxic; before it, in the toxic
dictionary only, a part of the toxic documents' windows which the other fold's dictionaries found most toxic. That choice is repeated
`rounds` times, so that the toxic part comes to hold what toxic documents say and others don't. The calibration sees whole texts.

The model (some 200 KB) is broadcast; documents are scored in one pass over whole texts, without a shuffle, a slice of about 1 MB at a
time, however long a text is.

Defined results: a null text is an empty one, whose score is the calibration's for no windows; without learning rows of both labels
every score is the share of toxic ones among them (0 without any); a label other than 0 and 1 or null counts as none; of several labels
for one doc_id the greatest counts; rows without doc_id are never learned from nor held out; repeated rows are scored alike; an empty
table gives an empty result; columns other than doc_id and text, doc_id and toxic, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, tidied, written
from .wordkernel import LOWER, slices, text_bytes

WIDTH, LEVEL, SHORTEST = 36, 3, 5
THRESHOLDS = (3, 4, 5, 6, 7)
NUMBERS = 5 + len(THRESHOLDS)
FOLDS, CALIBRATE = 8, 6  # folds 0-2 and 3-5 for dictionaries, the rest for calibration
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def windows(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of the windows of rows that lie in data at off: each multiple of width from a row's start is moved on to
    the next white space, by 4 * width bytes at most."""
    spaces = np.flatnonzero(_SPACE[data])
    size = np.diff(off)
    count = np.maximum(0, (size - 1) // width)
    row = np.repeat(np.arange(len(size)), count)
    target = off[:-1][row] + width * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1)
    place = np.searchsorted(spaces, target)
    found = np.append(spaces, len(data))[place] if len(spaces) else np.full(len(target), len(data))
    found = np.where(found > target + 4 * width, target, found)
    inside = found < off[1:][row]
    own = np.flatnonzero(size > 0)
    start = np.concatenate([off[:-1][own], found[inside]])
    of = np.concatenate([own, row[inside]])
    start, at = np.unique(start, return_index=True)
    of = of[at]
    end = np.append(start[1:], len(data))
    return start, np.minimum(end, off[1:][of]) - start, of


def compressor(dictionary: bytes):
    import zstandard as zstd

    own = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    # tables that hold every place of the dictionary; short matches, as words are short
    p = zstd.ZstdCompressionParameters.from_level(LEVEL, window_log=20, hash_log=20, chain_log=20, min_match=SHORTEST, strategy=zstd.STRATEGY_DFAST, write_checksum=0, write_content_size=0, write_dict_id=0)
    own.precompute_compress(compression_params=p)
    return zstd.ZstdCompressor(compression_params=p, dict_data=own)


def lengths(tool, data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Compressed length of each window of data."""
    import zstandard as zstd

    out = np.zeros(len(start), np.int64)
    own = np.flatnonzero(size > 0)
    if len(own):
        segments = np.stack([start[own], size[own]], 1).astype(np.uint64).tobytes()
        made = tool.multi_compress_to_buffer(zstd.BufferWithSegments(data, segments), threads=1)
        out[own] = np.fromiter(map(len, (made[i] for i in range(len(made)))), np.int64, len(made))
    return out


@dataclass
class Model:
    """Dictionaries and calibration; without dictionaries, the share of toxic rows alone."""

    toxic: bytes = b""
    ordinary: bytes = b""
    middle: np.ndarray = field(default_factory=lambda: np.zeros(NUMBERS))
    spread: np.ndarray = field(default_factory=lambda: np.ones(NUMBERS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(NUMBERS + 1))
    share: float = 0.0

    def score(self, numbers: np.ndarray) -> np.ndarray:
        if not self.toxic:
            return np.full(len(numbers), self.share)
        z = np.clip((numbers - self.middle) / self.spread, -6, 6)
        return 1 / (1 + np.exp(-(self.weights[0] + z @ self.weights[1:])))


class Scale:
    """Distances of windows under a pair of dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)

    def distances(self, data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return lengths(self.ordinary, data, start, size) - lengths(self.toxic, data, start, size)

    def numbers(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """What the calibration takes of each row of lower-cased bytes."""
        start, size, row = windows(data, off)
        d = self.distances(data.tobytes(), start, size)
        rows = len(off) - 1
        out = np.zeros((rows, NUMBERS))
        n = np.bincount(row, minlength=rows)
        own = np.flatnonzero(n)
        order = np.lexsort((-d, row))
        total = np.concatenate([[0.0], np.cumsum(d[order])])
        first = (np.cumsum(n) - n)[own]
        many = n[own]
        top = lambda k: (total[first + np.minimum(k, many)] - total[first]) / np.minimum(k, many)
        out[own, 0] = top(1)
        out[own, 1] = top(3)
        out[own, 2] = top(np.maximum(1, many // 30))
        out[own, 3] = top(many)
        out[:, 4] = np.log1p(n)
        for k, t in enumerate(THRESHOLDS):
            out[own, 5 + k] = np.bincount(row, weights=d >= t, minlength=rows)[own] / many
        return out


def trained(samples: list[bytes], size: int, piece: int) -> bytes:
    """The content of a dictionary of at most size bytes trained from distinct windows; all of them, where they fit in it."""
    import zstandard as zstd

    own = sorted(set(samples), key=lambda w: (zlib.crc32(w), w))
    if sum(map(len, own)) <= size:
        return b"".join(own)
    try:
        made = zstd.train_dictionary(size, own, k=piece, d=6, level=LEVEL).as_bytes()
        return made[-(size - 256) :]  # without the entropy tables in front
    except zstd.ZstdError:  # too little for it to choose from
        return b"".join(own)[:size]


def dictionaries(toxic: list[tuple[int, list[bytes]]], ordinary: list[tuple[int, list[bytes]]], rounds: int, share: int, sizes: tuple[int, int, int], piece: int) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries from windows of documents (fold, windows). sizes: of the toxic, the seemingly toxic and the base part."""
    sides = [[[ws for f, ws in docs if (f < 3) == side] for docs in (toxic, ordinary)] for side in (True, False)]
    flat = lambda docs: [w for ws in docs for w in ws]
    base = trained(flat(sides[0][1] + sides[1][1]), sizes[2], piece)
    picked = [[flat(docs) for docs in side] for side in sides]

    def pair(samples: list[list[bytes]]) -> tuple[bytes, bytes]:
        both = trained(samples[1], sizes[1], piece) + base
        own = trained(samples[0], sizes[0], piece)
        # the toxic part is in front, so what both hold is as near in the one as in the other; and zstd enters a dictionary's places
        # by threes, so only a multiple of three lets it find the same of that in both
        return own[len(own) % 3 :] + both, both

    def most_toxic(docs: list[list[bytes]], scale: Scale) -> list[bytes]:
        out = []
        data = flat(docs)
        size = np.fromiter(map(len, data), np.int64, len(data))
        d = scale.distances(b"".join(data), np.cumsum(size) - size, size) if data else size
        at = 0
        for ws in docs:
            own = d[at : at + len(ws)]
            out += [data[at + i] for i in np.argsort(-own, kind="stable")[: max(1, len(ws) // share)] if own[i] > 0]
            at += len(ws)
        return out

    for _ in range(rounds):
        scales = [Scale(*pair(p)) for p in picked]
        new = [[most_toxic(docs, scales[1 - k]) for docs in sides[k]] for k in (0, 1)]
        if not any(p[0] for p in new):
            break
        picked = new
    return pair([picked[0][k] + picked[1][k] for k in (0, 1)])


def calibrated(numbers: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(middle, spread, weights) of a logistic regression on standardised numbers, by Newton's steps."""
    middle, spread = numbers.mean(0), numbers.std(0) + 1e-9
    z = np.c_[np.ones(len(numbers)), np.clip((numbers - middle) / spread, -6, 6)]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (labels - p) - ridge * w)
        w += np.clip(step, -2, 2)
    return middle, spread, w


def fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, lower-cased bytes, offsets) of slices of the batch's texts."""
    data, off = text_bytes(batch.column("text"))
    for i, j in slices(off):
        yield i, j, LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]


def _sampled(sample: DataFrame, sample_windows: int) -> DataFrame:
    """toxic, fold, windows (one string after the other, with their lengths) of learning rows."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, sizes = [], []
            for i, j, data, off in _rows_of(batch):
                start, size, row = windows(data, off)
                first = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    n = first[r + 1] - first[r]
                    own = first[r] + (np.arange(min(n, sample_windows)) * n) // max(1, min(n, sample_windows))
                    text.append(b"".join(data[s : s + z].tobytes() for s, z in zip(start[own], size[own], strict=True)))
                    sizes.append(size[own].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("fold"), batch.column("h"), pa.array(text, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))], ["toxic", "fold", "h", "windows", "sizes"])

    return sample.mapInArrow(work, "toxic int, fold int, h long, windows binary, sizes array<long>")


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, sample_docs: int = 6000, sample_windows: int = 128, rounds: int = 4, share: int = 15, sizes: tuple[int, int, int] = (1 << 13, 1 << 17, 1 << 16), piece: int = 16) -> Model:
    """A model from at most sample_docs labelled rows of each label, of those that aren't held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(modulus) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("known_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda df, *by: [df.filter(F.col("toxic") == k).orderBy(*by).limit(sample_docs) for k in (0, 1)]
    few = first(known, F.xxhash64("known_id"), "known_id")
    chosen = F.broadcast(few[0].unionByName(few[1]))  # 2 * sample_docs rows of two numbers at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("known_id"))
    rows = rows.select("toxic", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), F.xxhash64("text", "doc_id").alias("h"))
    with scratch(docs.sparkSession):
        sample = written(rows, "labelled")
        own = [list(zip(*(t.column(c).to_pylist() for c in ("fold", "windows", "sizes")), strict=True)) for t in (x.toArrow() for x in first(_sampled(sample.filter(F.col("fold") < CALIBRATE), sample_windows), "h", "fold"))]
        counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        model = Model(share=counts.get(1, 0) / total if total else 0.0)
        cut = lambda text, sizes: [text[e - z : e] for e, z in zip(np.cumsum(sizes).tolist(), sizes, strict=True)]
        ordinary, toxic = ([(f, cut(text, z)) for f, text, z in x] for x in own)
        if not any(ws for _, ws in toxic) or not any(ws for _, ws in ordinary):
            return model
        model.toxic, model.ordinary = dictionaries(toxic, ordinary, rounds, share, sizes, piece)
        seen = [x.toArrow() for x in first(_measured(sample.filter(F.col("fold") >= CALIBRATE), model), "h", "fold")]
    numbers = np.concatenate([np.array(t.column("numbers").to_pylist(), float).reshape(-1, NUMBERS) for t in seen])
    labels_ = np.concatenate([np.full(t.num_rows, k) for k, t in enumerate(seen)])
    if not all(t.num_rows for t in seen):
        return Model(share=model.share)
    model.middle, model.spread, model.weights = calibrated(numbers, labels_)
    return model


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = Scale(shared.value.toxic, shared.value.ordinary)
        for batch in batches:
            found = [scale.numbers(data, off) for _, _, data, off in _rows_of(batch)]
            numbers = pa.array(np.concatenate(found).tolist() if found else [], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("toxic", "fold", "h")), numbers], names=["toxic", "fold", "h", "numbers"])

    return rows.mapInArrow(work, "toxic int, fold int, h long, numbers array<double>")


def scored(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, scale = shared.value, None
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if not m.toxic:
                score[:] = m.share
            else:
                scale = scale or Scale(m.toxic, m.ordinary)
                for i, j, data, off in _rows_of(batch):
                    score[i:j] = m.score(scale.numbers(data, off))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(modulus) == held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the labels of those that aren't held out."""
    return scored(docs, learn(docs, labels, **options))
