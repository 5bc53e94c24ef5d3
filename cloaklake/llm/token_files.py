"""Token-ID files: Arrow streams of fixed-size-list batches, for zero-copy random access to equal-length sequences and masks.

The ids of all documents, in ascending doc_id order, are one long stream. Each range of it, of about `shard_bytes` bytes of text
at the most (so more input has more shards, not larger ones), is a shard of two files:
`tokens-<k>.arrow` holds the shard's ids cut into rows (input_ids fixed_size_list[seq_len], attention_mask
fixed_size_list[seq_len], the last row padded), in record batches of equal numbers of rows, so that row r of a memory-mapped
file is batch r // rows, row r % rows, without a copy; `index-<k>.arrow` holds doc_id, start in the shard and n_tokens.

Documents move once, by range of doc_id and a hash of the text; a shard is encoded as a stream, so a task holds one batch of rows
of text at a time, and read again as a stream, by record batch.
Files get their final name by a rename, and a repeated task writes the same bytes, so a lost executor does no harm.

The library encodes every distinct piece of text once for each worker: a text falls into pieces at places (see cuts) where the
byte-level pre-tokenizer always splits as well; tests compare with whole texts.

Defined results: a null or empty text has just the end id; equal doc_ids stand side by side, ordered by a hash of their text;
null doc_ids come first; rows equal in both are in one shard; an empty table has no files and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_path, tidied, written
from .wordkernel import CodeTable, mixed, powers, slices, text_bytes

#: Bytes of white space in ASCII, and first bytes of characters beyond it of which some are white space.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_PERHAPS = np.zeros(256, bool)
_PERHAPS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != ord("|")]] = True

_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker process: what it has encoded serves its later tasks as well."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


class PieceEncoder:
    """Ids of texts by the tokenizers library, each distinct piece encoded once while it is remembered (by a 64-bit hash)."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.table = CodeTable()
        self.flat = np.zeros(1 << 16, self.dtype)
        self.off = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = []
        for a in range(0, len(texts), 8192):  # the library's results are far larger than their ids
            ids += [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts[a : a + 8192], add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.concatenate(ids)
        a, used = self.off[self.used], self.used + len(texts)
        while used + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        while a + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[a : a + len(new)] = new
        self.off[self.used + 1 : used + 1] = a + np.cumsum(n)
        self.table.add(keys, np.arange(self.used, used))
        self.used = used

    @staticmethod
    def cuts(d: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Where pieces start. All are places where the pre-tokenizer ends a token whatever stands around:
        each text's start; before a single blank, and before and after a single line break, between characters that surely aren't
        white space; between an ASCII or Latin-1 letter and ASCII punctuation (but | of the end-of-text mark)."""
        cut = np.zeros(len(d) + 1, bool)
        if len(d) > 2:
            edge = np.zeros(len(d) + 1, bool)
            edge[o] = True
            space = _SPACE[d]
            at = np.flatnonzero(space[1:-1] & ~space[:-2] & ~space[2:]) + 1
            before = d[at - 1]
            safe = ~(edge[at] | edge[at + 1] | _PERHAPS[d[at + 1]])
            safe &= ~((before >= 0x80) & (_PERHAPS[d[np.maximum(at - 2, 0)]] | _PERHAPS[d[np.maximum(at - 3, 0)]]))
            at = at[safe]
            blank, line = at[d[at] == 0x20], at[d[at] == 0x0A]
            cut[blank] = cut[line] = cut[line + 1] = True
            mark = np.flatnonzero(_PUNCTUATION[d[1:]]) + 1
            b = d[mark - 1]
            latin = (b >= 0x80) & (d[np.maximum(mark - 2, 0)] == 0xC3) & (b != 0x97) & (b != 0xB7)
            cut[mark[_LETTER[b] | latin]] = True
        cut[o[:-1]] = True
        return np.flatnonzero(cut[:-1]) if len(d) else np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts i..j, each followed by end_id, and how many each text has with it."""
        o, d = off[i : j + 1] - off[i], data[off[i] : off[j]]
        start = self.cuts(d, o)
        n = np.diff(start, append=len(d))
        if len(start):
            place = np.arange(len(d)) - np.repeat(start, n)
            key = np.add.reduceat((d.astype(np.uint64) + np.uint64(1)) * powers(int(n.max()))[place], start)
            key = mixed(key + n.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        else:
            key = np.zeros(0, np.uint64)
        code = self.table.find(key)
        if (code < 0).any():
            if self.used > self.most:
                self._forget()
                code[:] = -1
            new = np.flatnonzero(code < 0)
            own, first = np.unique(key[new], return_index=True)
            raw = d.tobytes()
            self._learn(own, [raw[start[k] : start[k] + n[k]].decode() for k in new[first].tolist()])
            code[new] = self.table.find(key[new])
        a = self.off[code]
        size = self.off[code + 1] - a
        row_end = np.searchsorted(start, o[1:])  # an end id goes before the piece that begins the next text
        total = np.concatenate([[0], np.cumsum(size)])
        n_tokens = np.diff(total[row_end], prepend=0) + 1
        out = np.empty(total[-1] + (j - i), self.dtype)
        ends = np.cumsum(n_tokens) - 1
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[ends] = end_id
        out[keep] = self.flat[np.arange(total[-1]) + np.repeat(a - total[:-1], size)]
        return out, n_tokens


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


class _Stream:
    """A stream file in the making: rows gathered to full batches, renamed into place at the end."""

    def __init__(self, fs: pafs.FileSystem, path: str, schema: pa.Schema, tag: str):
        self.fs, self.path, self.temporary = fs, path, f"{path}.{tag}.tmp"
        self.out = fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_stream(self.out, schema)

    def write(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch)

    def close(self) -> None:
        self.writer.close()
        self.out.close()
        self.fs.move(self.temporary, self.path)


def sequence_schema(seq_len: int, dtype: type) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("attention_mask", pa.list_(pa.bool_(), seq_len))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, seq_len: int = 2048, rows: int = 512, end_id: int = 0, shards: int | None = None, order: list[str] | None = None, shard_bytes: int = 1 << 28) -> DataFrame:
    """Encode and write all documents; returns a table (shard, docs, tokens) of the files written. order: columns of docs, by default doc_id and a hash of the text."""
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))

    @tidied
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tokens, index, base, docs_seen = None, None, None, 0, 0
        k, tag = TaskContext.get().partitionId(), f"{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if encode is None:
                encode = encoder(tokenizer)
                schema = sequence_schema(seq_len, encode.dtype)
                fs, root = opened(folder)
                fs.create_dir(root, recursive=True)
                tokens, index = _Stream(fs, f"{root}/tokens-{k:06d}.arrow", schema, tag), _Stream(fs, f"{root}/index-{k:06d}.arrow", INDEX, tag)
                rest = np.zeros(0, encode.dtype)

                def put(ids: np.ndarray, real: int, schema: pa.Schema = schema, tokens: _Stream = tokens) -> None:
                    mask = np.arange(len(ids)) < real
                    cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), seq_len) for x in (ids, mask)]
                    tokens.write(pa.RecordBatch.from_arrays(cols, schema=schema))

            data, off = text_bytes(batch.column("text"))
            for i, j in slices(off):
                ids, n = encode(data, off, i, j, end_id)
                starts = base + np.cumsum(n) - n
                index.write(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(starts), pa.array(n)], schema=INDEX))
                base, docs_seen = base + len(ids), docs_seen + j - i
                rest = np.concatenate([rest, ids])
                whole = seq_len * rows
                done = len(rest) // whole * whole
                for b in range(0, done, whole):
                    put(rest[b : b + whole], whole)
                rest = rest[done:].copy()
        if encode is not None:
            if len(rest):
                padded = np.full(-(-len(rest) // seq_len) * seq_len, end_id, rest.dtype)
                padded[: len(rest)] = rest
                put(padded, len(rest))
            tokens.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": [k], "docs": [docs_seen], "tokens": [base]})

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"_{i}") for i, c in enumerate(order or [])])
    keys = [f"_{i}" for i, _ in enumerate(order)] if order else ["doc_id", F.xxhash64("text")]
    placed = df.repartitionByRange(shards, *keys).sortWithinPartitions(*keys, *([] if order else ["text"]))
    return written(placed.select("doc_id", "text").mapInArrow(shard, "shard long, docs long, tokens long"), "token-shards")


def read_sequences(path: str) -> pa.Table:
    """A shard's sequences and masks, memory-mapped where the path is local: no copy, random access by row."""
    fs, p = opened(path)
    source = pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p)
    return pa.ipc.open_stream(source).read_all()


def batches_of(path: str) -> Iterator[pa.RecordBatch]:
    """A file's record batches, one after the other: memory-mapped where the path is local, else read one at a time."""
    fs, p = opened(path)
    with pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_stream(p) as source:
        yield from pa.ipc.open_stream(source)


def flat_ids(path: str) -> Iterator[np.ndarray]:
    """The ids of a shard's record batches, without a copy."""
    for batch in batches_of(path):
        yield batch.column(0).flatten().to_numpy(zero_copy_only=True)


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. shards: what write_tokens() returned."""
    spark = shards.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    @tidied
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, root = opened(folder)
        head = folder[: len(folder) - len(root)]
        for batch in batches:
            for k, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, more = np.zeros(0, np.uint16), flat_ids(f"{head}{root}/tokens-{k:06d}.arrow")
                for index in batches_of(f"{head}{root}/index-{k:06d}.arrow"):
                    crc = []
                    start, n = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                    for m in n.tolist():  # documents follow one another
                        c = 0
                        while m:
                            ids = ids if len(ids) else next(more)
                            got, ids = ids[:m], ids[m:]
                            c, m = zlib.crc32(got.astype("<u4").data, c), m - len(got)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([index.column("doc_id"), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return places.select("shard", "base").repartition(n, "shard").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_corpus(docs: DataFrame, tokenizer: str, **options: object) -> DataFrame:
    """Write the token files of docs in the shared folder and read every document's ids back from them."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, **options), folder)
