"""Restoring placeholders in streams, also where one is split over events, and events over chunks, and both over micro-batches.

For each stream and part (choice in A, block in B) two buffers hold back what may be the start of a placeholder: of personal
data, and, after that, of secrets. Buffers are flushed before the stream's or block's end marker, or when a stream falls silent.
Lines that aren't events with text, of whatever JSON shape, pass as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import placeholders
from ..sources.sse import DONE, PREFIX, Framer, delta_text, parsed

OUT = "stream_id string, seq long, part int, line string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# word characters and brackets up to the end, from a bracket on; apart: marks that are whole, with no bracket near them
_CLUSTER = re.compile(r"\[[A-Za-z0-9_\[\]]*\Z")
_APART = re.compile(rf"(?:{placeholders.MARK}[A-Za-z0-9_]*)+\Z")


def safe_length(text: str, hold_bracket: bool = True) -> int:
    """How much of text can go out: all before an unfinished placeholder, or before brackets that more text may make one of;
    a lone bracket at the end may begin one."""
    at = text.rfind("[[")
    end = at if at >= 0 and "]]" not in text[at:] else len(text)
    if not hold_bracket:
        return end
    near = _CLUSTER.search(text, 0, end)
    return near.start() if near and not _APART.match(text, near.start(), end) else end


def restore(text: str, values: dict[str, str], marker: str = "") -> str:
    for k in sorted(values, key=lambda k: (-len(k), k)):
        text = text.replace(k, marker + values[k])
    return text


def dumped(tree: object) -> str:
    """JSON on one line; with escapes where it holds half of a surrogate pair, which UTF-8 can't."""
    out = json.dumps(tree, ensure_ascii=False, separators=(",", ":"))
    try:
        out.encode()
    except UnicodeEncodeError:
        out = json.dumps(tree, separators=(",", ":"))
    return out


def place(index: object, otherwise: int) -> str:
    """The part that an event's index names; `otherwise` where it names none."""
    return str(index if isinstance(index, int) and not isinstance(index, bool) else otherwise)


class Unmasker:
    """The state of one stream. buffers: part to [personal data, secrets]."""

    def __init__(self, dialect: str, pii: dict[str, str], secrets: dict[str, str], marker: str = "", buffers: dict | None = None):
        self.dialect, self.values, self.markers = dialect, (pii, secrets), (marker, "")
        self.buffers: dict[str, list[str]] = buffers or {}
        self.ended = False

    def _through(self, part: str, text: str, end: bool = False) -> str:
        held = self.buffers.setdefault(part, ["", ""])
        for i, values in enumerate(self.values):
            if not values:
                text, held[i] = held[i] + text, ""
                continue
            text = held[i] + text
            cut = len(text) if end else safe_length(text)
            text, held[i] = restore(text[:cut], values, self.markers[i]), text[cut:]
        return text

    def _event(self, part: str, text: str) -> str:
        if self.dialect == "A":
            tree = {"choices": [{"index": int(part), "delta": {"content": text}, "finish_reason": None}]}
        else:
            tree = {"type": "content_block_delta", "index": int(part), "delta": {"type": "text_delta", "text": text}}
        return PREFIX + dumped(tree)

    def flush(self, part: str | None = None) -> list[str]:
        """What buffers still hold, restored, as events of their own; of one part, or of all."""
        out = []
        for p in [part] if part is not None else sorted(self.buffers, key=int):
            if p in self.buffers and (text := self._through(p, "", end=True)):
                out.append(self._event(p, text))
            self.buffers.pop(p, None)
        return out

    def feed(self, line: str | None) -> list[str]:
        """The lines that go out for a line that came in; a null line is an empty one."""
        line = line or ""
        if not line.startswith(PREFIX):
            return [line]
        data = line[len(PREFIX) :]
        if data == DONE:
            self.ended = True
            return [*self.flush(), line]
        try:
            tree = json.loads(data)
        except (ValueError, RecursionError):
            return [line]
        if not isinstance(tree, dict):
            return [line]
        return self._feed_a(tree, line) if self.dialect == "A" else self._feed_b(tree, line)

    def _feed_a(self, tree: dict, line: str) -> list[str]:
        texts, held = False, True
        choices = tree.get("choices")
        for n, c in enumerate(choices if isinstance(choices, list) else []):
            delta = c.get("delta") if isinstance(c, dict) else None
            text = delta.get("content") if isinstance(delta, dict) else None
            if isinstance(text, str) and text:
                texts = True
                delta["content"] = self._through(place(c.get("index"), n), text)
                held &= not delta["content"] and not c.get("finish_reason")
        if not texts:
            return [line]
        return [] if held else [PREFIX + dumped(tree)]

    def _feed_b(self, tree: dict, line: str) -> list[str]:
        kind, delta = tree.get("type"), tree.get("delta")
        if kind == "content_block_stop":
            return [*self.flush(place(tree.get("index"), 0)), line]
        if kind == "message_stop":
            self.ended = True
            return [*self.flush(), line]
        if kind != "content_block_delta" or not isinstance(delta, dict) or delta.get("type") != "text_delta" or not isinstance(delta.get("text"), str):
            return [line]
        delta["text"] = self._through(place(tree.get("index"), 0), delta["text"])
        return [PREFIX + dumped(tree)] if delta["text"] else []


def with_contexts(lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """lines with pii and secrets, the maps of their stream. contexts: stream_id, kind (pii, secret), placeholder, value; static."""
    of = lambda kind: F.map_from_entries(F.array_compact(F.collect_set(F.when(F.col("kind") == kind, F.struct("placeholder", "value")))))
    maps = contexts.groupBy("stream_id").agg(of("pii").alias("pii"), of("secret").alias("secrets"))
    return lines.join(maps, "stream_id", "left")


def _maps(frame: pd.DataFrame) -> tuple[dict, dict]:
    pick = lambda c: dict(next((m for m in frame[c] if m is not None), None) or {})
    return pick("pii"), pick("secrets")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["stream_id", "seq", "part", "line"])


def unmask_batch(lines: DataFrame, dialect: str, marker: str = "") -> DataFrame:
    """A finished set of streams: lines with pii and secrets to (stream_id, seq, part, line); what is held at the end goes out last.

    Streams lie whole and in order in partitions, through which the state machine goes line by line: a task holds a batch of lines.
    Of lines with one seq the first by its bytes counts; gaps between seqs don't matter here.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, key, last = None, None, -1
        for frame in frames:
            rows = []
            for stream_id, seq, line, pii, secrets in zip(frame["stream_id"], frame["seq"], frame["line"], frame["pii"], frame["secrets"], strict=True):
                if (stream_id, seq) == (key, last) and u:
                    continue
                if u is None or stream_id != key:
                    rows += [(key, last, 1000 + i, x) for i, x in enumerate(u.flush())] if u else []
                    u, key = Unmasker(dialect, dict(pii if pii is not None else {}), dict(secrets if secrets is not None else {}), marker), stream_id
                rows += [(key, seq, part, x) for part, x in enumerate(u.feed(line))]
                last = seq
            yield _frame(rows)
        if u:
            yield _frame([(key, last, 1000 + i, x) for i, x in enumerate(u.flush())])

    placed = lines.select("stream_id", "seq", "line", "pii", "secrets").repartition("stream_id").sortWithinPartitions("stream_id", "seq", "line")
    return placed.mapInPandas(work, OUT)


def restored_streams(lines: DataFrame, dialect: str, marker: str | None = None) -> DataFrame:
    """stream_id, part, text: what finished streams say, restored. lines: stream_id, seq, line, pii, secrets. DataFrame functions
    only: a placeholder that events split is whole again in the joined text. Events without text add none."""
    event = parsed(lines).filter(F.col("event").isNotNull())
    if dialect == "A":
        choice = F.posexplode(F.try_variant_get("event", "$.choices", "array<variant>")).alias("i", "c")
        rows = event.select("stream_id", "seq", "pii", "secrets", choice)
        rows = rows.select("*", F.coalesce(F.try_variant_get("c", "$.index", "int"), F.col("i")).alias("part"), F.try_variant_get("c", "$.delta.content", "string").alias("text"))
    else:
        rows = event.select("stream_id", "seq", "pii", "secrets", F.lit(0).alias("i"), F.coalesce(F.try_variant_get("event", "$.index", "int"), F.lit(0)).alias("part"), delta_text("event", dialect).alias("text"))
    rows = rows.filter(F.col("text").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("seq", "i", "text")))
    out = rows.groupBy("stream_id", "part").agg(F.array_join(F.transform(parts, lambda x: x.text), "").alias("text"), F.any_value("pii", True).alias("pii"), F.any_value("secrets", True).alias("secrets"))
    empty = F.create_map().cast("map<string,string>")
    return out.select("stream_id", "part", placeholders.restore_both(F.col("text"), F.coalesce("pii", empty), F.coalesce("secrets", empty), marker).alias("text"))


WAIT = {"seconds": 1_000, "second": 1_000, "minutes": 60_000, "minute": 60_000, "hours": 3_600_000, "hour": 3_600_000}


class Restorer(StatefulProcessor):
    """One stream's state over micro-batches: which item is next, items that came before their turn, the bytes of an unfinished
    line (where items are chunks), maps and buffers.

    Items go through in the order of seq, from `first` on, each once: one whose seq has been, or is waiting already, is dropped.
    When the stream has been silent for `silence` milliseconds, what waits for missing items goes through in order, the unfinished
    line and the buffers go out, and the state is removed. An end marker empties buffers; what little stays (the next seq)
    keeps repeated items from coming out again, until the silence.
    """

    def __init__(self, dialect: str, marker: str, silence: int | None, first: int, chunks: bool):
        self.dialect, self.marker, self.silence, self.first, self.chunks = dialect, marker, silence, first, chunks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stream = handle.getValueState("stream", "pii string, secrets string, buffers string, carry binary, next long, line long")
        self.waiting = handle.getListState("waiting", "seq long, item binary")

    def _work(self, key: str, items: dict[int, bytes], given: tuple[dict, dict], over: bool) -> list[tuple]:
        pii, secrets, buffers, carry, due, line = self.stream.get() if self.stream.exists() else ("{}", "{}", "{}", b"", self.first, 0)
        pii, secrets = (json.loads(x) or y for x, y in zip((pii, secrets), given, strict=True))
        u = Unmasker(self.dialect, pii, secrets, self.marker, json.loads(buffers))
        framer = Framer(bytes(carry))
        old = {s: bytes(x) for s, x in self.waiting.get()}
        left = {s: x for s, x in {**items, **old}.items() if s >= due}
        out: list[tuple] = []

        def through(lines: list[str], seq: int) -> int:
            for text in lines:
                out.extend((key, seq, part, x) for part, x in enumerate(u.feed(text)))
                seq += 1
            return seq

        while left and (due in left or over):
            due = due if due in left else min(left)
            item = left.pop(due)
            if self.chunks:
                line = through(framer.feed(item), line)
            else:
                through([item.decode("utf-8", "replace")], due)
            due += 1
        if over:
            line = through(framer.end(), line)
            last = line - 1 if self.chunks else due - 1
            out += [(key, last, 1000 + i, x) for i, x in enumerate(u.flush())]
            self.stream.clear()
            self.waiting.clear()
            return out
        self.stream.update((json.dumps(pii), json.dumps(secrets), json.dumps(u.buffers), framer.carry, due, line))
        if left != old:
            self.waiting.put(list(left.items())) if left else self.waiting.clear()
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        items: dict[int, bytes] = {}
        given: tuple[dict, dict] = {}, {}
        for frame in rows:
            for seq, item in zip(frame["seq"], frame["item"], strict=True):
                own = b"" if item is None else bytes(item)
                items[int(seq)] = min(items.get(int(seq), own), own)
            given = tuple(x or y for x, y in zip(given, _maps(frame), strict=True))
        if self.silence:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield _frame(self._work(key[0], items, given, over=False))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield _frame(self._work(key[0], {}, ({}, {}), over=True))

    def close(self) -> None:
        pass


def _restored(items: DataFrame, dialect: str, marker: str, silence: str | None, first: int, chunks: bool) -> DataFrame:
    number, unit = silence.split() if silence else ("0", "seconds")
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = Restorer(dialect, marker, int(number) * WAIT[unit] or None, first, chunks)
    return items.groupBy("stream_id").transformWithStateInPandas(processor, OUT, "append", "ProcessingTime" if silence else "None")


def unmask_stream(lines: DataFrame, dialect: str, marker: str = "", silence: str | None = None, first: int = 0) -> DataFrame:
    """The same over a streaming DataFrame of lines (stream_id, seq, line, pii, secrets), in whatever order and micro-batches they come:
    seq counts from `first` without gaps, and lines wait for those before them. silence (such as "10 minutes") ends a stream, gaps
    or not; without one, streams wait forever. State is kept in RocksDB, which this sets for the session."""
    items = lines.filter("seq IS NOT NULL").select("stream_id", "seq", F.col("line").cast("binary").alias("item"), "pii", "secrets")
    return _restored(items, dialect, marker, silence, first, False)


def unmask_chunks(chunks: DataFrame, dialect: str, marker: str = "", silence: str | None = None, first: int = 0) -> DataFrame:
    """As unmask_stream(), from chunks as they come over the wire (stream_id, n, chunk: binary or string; pii, secrets): a line, and a
    character, may be split over chunks anywhere, and over micro-batches. seq counts the lines."""
    items = chunks.filter("n IS NOT NULL").select("stream_id", F.col("n").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("item"), "pii", "secrets")
    return _restored(items, dialect, marker, silence, first, True)
