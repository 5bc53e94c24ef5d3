"""Conversation structure repair: the cheapest edits that make a conversation's turns alternate, by DP over a trie of signatures.

A conversation's messages stand by turn (nulls first), then role and text. Each message has at most one fault: blank (nothing but
white space), else duplicate (its role and text stand earlier), else truncated (its last visible character ends no sentence).
Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate messages have to go), Insert an empty message
anywhere 3; a truncated message that isn't deleted costs 3 more. What is left must have the role initials (s?(ua)+)?; of the cheapest
edits those whose initials, in order, come first in ASCII.

Method: a message is one symbol (role initial and fault), a conversation the string of its symbols, its signature. Where the repaired
part ends (nothing yet, after s, u, a) is one of four states, and a DP layer holds the least cost of each. Sorted signatures go
through a prefix trie: the layers of a shared prefix are worked out once, and each terminal node is answered from the layers on its
path, walking back over what is optimal, then forward by the ASCII-least letter. As a state and a letter fix what follows, that is
exact.

How it runs: conversations are hashed by conv_id and sorted within partitions; a task takes them in batches through one trie. A
conversation of more than `long_rows` messages is dealt out instead: duplicates by joins on digests, its messages sorted by
range over all partitions and cut into segments, layers for each of the four states that a segment may begin in, a chain of
segments (one small row each) that settles where each begins and ends, and its edits segment by segment. Only hashing goes through a
conversation in order, piece by piece, since SHA-256 has to. Both ways give the same.

Defined results: null conv_id is a conversation of its own; null role or text is one space, so such a text is blank; a null turn stands
first and doesn't count in gaps; messages alike in turn, role and text are interchangeable; a conversation without messages has
zeros, an empty audit and the empty string's hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, tidied, written

OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SPACE = " \t\n\v\f\r"
ENDS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
# states: 0 nothing yet, 1 after s, 2 after u, 3 after a
AFTER = (2, 2, 3, 2)  # what a user or assistant message leads to; which of them it is follows from the state
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None, None, None, None)}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLE_OF = {2: "user", 3: "assistant"}


def fault_of(role: str, text: str, earlier: bool) -> str:
    """B, D, T or nothing."""
    left = text.rstrip(SPACE)
    return "B" if not left else "D" if earlier else "" if left.endswith(ENDS) else "T"


def symbol_of(role: str, fault: str) -> str:
    """x where the message has to go, else its role's initial (o: another one), in capitals where it is truncated."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return "x" if fault in ("B", "D") and fault else initial.upper() if fault else initial


def moves(symbol: str) -> list[tuple[str, int, tuple]]:
    """(letter, cost, state to state) of a message's edits, by letter."""
    if symbol == "x":
        return [("D", DELETE, (0, 1, 2, 3))]
    extra = TRUNCATED if symbol.isupper() else 0
    return [("D", DELETE, (0, 1, 2, 3)), ("K", extra, KEPT[symbol.lower()]), ("R", REROLE + extra, AFTER)]


MOVES = {s: moves(s) for s in "xsuaoSUAO"}


def inserted(costs: tuple) -> tuple:
    """Costs where messages may be inserted next."""
    z, s, u, a = costs
    u = min(u, z + INSERT, s + INSERT, a + INSERT)
    a = min(a, u + INSERT)
    return z, s, min(u, a + INSERT), a


def next_layer(costs: tuple, symbol: str) -> tuple:
    """Least costs after a message, given those before it."""
    open_, out = inserted(costs), [NEVER] * 4
    for _, cost, to in MOVES[symbol]:
        for q in range(4):
            if to[q] is not None and open_[q] + cost < out[to[q]]:
                out[to[q]] = open_[q] + cost
    return tuple(out)


def first_layer(start: int) -> tuple:
    return tuple(0 if q == start else NEVER for q in range(4))


def through_trie(signatures: list[str], starts: tuple[int, ...] = (0,)) -> Iterator[tuple[str, list[list[tuple]]]]:
    """Each distinct signature, in order, with its layers for each start state. What it shares with the one before is taken from it:
    the walk over the sorted signatures is the walk over their prefix trie, whose open path is all that is held."""
    paths = [[first_layer(s)] for s in starts]
    last = ""
    for signature in sorted(set(signatures)):
        shared = 0
        for x, y in zip(last, signature, strict=False):
            if x != y:
                break
            shared += 1
        for path in paths:
            del path[shared + 1 :]
            for symbol in signature[shared:]:
                path.append(next_layer(path[-1], symbol))
        last = signature
        yield signature, paths


def answer(signature: str, layers: list[tuple], end: int | None = None) -> tuple[int, str, int]:
    """(cost, letters, end state) of the cheapest and ASCII-least edits from the layers' start state; to `end` right after the last
    message, or (None) to the end of a conversation, with inserts at its end."""
    n = len(signature)
    open_ = [inserted(x) for x in layers]
    at_end = open_[n] if end is None else layers[n]
    least = min(at_end[0], at_end[3]) if end is None else at_end[end]
    if least >= NEVER:
        return NEVER, "", -1
    good = [{q for q in ((0, 3) if end is None else (end,)) if at_end[q] == least}]
    for i in range(n, -1, -1):
        if i < n:
            into = good[-1]
            good.append({q for q in range(4) for _, cost, to in MOVES[signature[i]] if to[q] in into and open_[i][q] + cost == layers_at(layers, open_, i + 1, n, end)[to[q]]})
        if i < n or end is None:
            for _ in range(3):  # u may come from a, which may come from u
                good[-1] |= {q for q in range(4) if AFTER[q] in good[-1] and open_[i][q] + INSERT == open_[i][AFTER[q]]}
    good.reverse()
    q = next(q for q in range(4) if layers[0][q] == 0)
    letters: list[str] = []
    i = 0
    while True:
        here = open_[i] if i < n or end is None else layers[n]
        if i == n and q in ((0, 3) if end is None else (end,)) and here[q] == least:
            return least, "".join(letters), q
        ahead = layers_at(layers, open_, i + 1, n, end) if i < n else None
        options = [(letter, to[q], i + 1) for letter, cost, to in MOVES[signature[i]] if to[q] is not None and to[q] in good[i + 1] and here[q] + cost == ahead[to[q]]] if i < n else []
        if (i < n or end is None) and AFTER[q] in good[i] and here[q] + INSERT == here[AFTER[q]]:
            options.append(("I", AFTER[q], i))
        letter, q, i = min(options)
        letters.append(letter)


def layers_at(layers: list[tuple], open_: list[tuple], i: int, n: int, end: int | None) -> tuple:
    """Costs that an optimal way has after message i: with inserts, except where a segment ends."""
    return open_[i] if i < n or end is None else layers[n]


def edited(letters: str, roles: list[str], texts: list[str], state: int = 0) -> list[str]:
    """The repaired messages as role:text."""
    out, row = [], 0
    for letter in letters:
        if letter == "K":
            state = KEPT[initial(roles[row])][state]
            out.append(f"{roles[row]}:{texts[row]}")
        elif letter in "RI":
            state = AFTER[state]
            out.append(f"{ROLE_OF[state]}:{texts[row] if letter == 'R' else ''}")
        row += letter != "I"
    return out


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) % 20, and gone: dropped rows stay as marks that theirs occurs."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key("role").alias("role"), key("text").alias("text"))
    rows = rows.withColumn("kind", F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn"))) % 20)
    rows = rows.withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        "copy": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"))


def turn_gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def digest_of(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class _Open:
    """One conversation as it is read: counts, its signature, and its messages until they are edited."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.roles, self.texts, self.symbols, self.size = conv_id, [], [], [], [], 0
        self.seen: set[bytes] = set()
        self.faults = {"B": 0, "D": 0, "T": 0}

    def add(self, turn: int | None, role: str, text: str) -> None:
        own = digest_of(role, text)
        fault = fault_of(role, text, own in self.seen)
        self.seen.add(own)
        if fault:
            self.faults[fault] += 1
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.symbols.append(symbol_of(role, fault))
        self.size += len(text) + 64

    def row(self, cost: int, letters: str) -> tuple:
        illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(self.roles, self.roles[1:], strict=False))
        whole = "\n".join(edited(letters, self.roles, self.texts))
        sha = hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()
        return self.conv_id, turn_gaps(self.turns), *(self.faults[f] for f in "BDT"), illegal, cost, letters, sha


def _schema() -> pa.Schema:
    return pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in (x.split()[0] for x in OUT.split(", "))])


def _answered(held: list[_Open]) -> pa.RecordBatch:
    """The rows of conversations, each distinct signature answered once."""
    signature = ["".join(c.symbols) for c in held]
    answers = {s: answer(s, paths[0])[:2] for s, paths in through_trie(signature)}
    rows = [c.row(*answers[s]) for c, s in zip(held, signature, strict=True)]
    schema = _schema()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _short(rows: DataFrame, batch_bytes: int) -> DataFrame:
    """Conversations that a task can hold: about batch_bytes of them go through one trie."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Open] = []
        size = 0
        for batch in batches:
            for conv_id, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if not held or held[-1].conv_id != conv_id:
                    if size >= batch_bytes:
                        yield _answered(held)
                        held, size = [], 0
                    held.append(_Open(conv_id))
                if not gone:
                    size -= held[-1].size
                    held[-1].add(turn, role, text)
                    size += held[-1].size
        if held:
            yield _answered(held)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(work, OUT)


SEGMENT = (
    "conv_id long, part int, no int, signature string, roles array<string>, texts array<string>, first_turn long, last_turn long, turns long, "
    "first_role string, last_role string, blank long, duplicate long, truncated long, illegal long"
)
ORDER = ["conv_id", "part", "no"]


def _segments(rows: DataFrame, segment_rows: int, segment_bytes: int) -> DataFrame:
    """Messages of long conversations, sorted over all partitions and cut. part and no give a segment's place."""
    # equal messages are interchangeable; a number, fixed by writing it, tells them apart, so that they too spread over partitions
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = written(rows.filter("NOT gone").select("conv_id", "turn", "role", "text", digest.alias("digest"), F.monotonically_increasing_id().alias("uid")), "long_messages")
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "uid")
    first = rows.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("like")).agg(F.min(place).alias("first"))
    told = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("like")), "left")
    told = told.select("conv_id", "turn", "role", "text", "uid", (F.col("first.uid") != F.col("uid")).alias("earlier"))
    keys = ["conv_id", "turn", "role", "text", "uid"]

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, own, size = TaskContext.get().partitionId(), 0, None, 0
        kind = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("signature", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())])

        def row(c: _Open) -> pa.RecordBatch:
            known = [t for t in c.turns if t is not None]
            illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(c.roles, c.roles[1:], strict=False))
            values = (c.conv_id, part, no, "".join(c.symbols), c.roles, c.texts, known[0] if known else None, known[-1] if known else None, len(set(known)), c.roles[0], c.roles[-1], *(c.faults[f] for f in "BDT"), illegal)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kind, strict=True)], schema=kind)

        for batch in batches:
            for conv_id, turn, role, text, earlier in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "earlier")), strict=True):
                if own is not None and (own.conv_id != conv_id or len(own.roles) >= segment_rows or own.size >= segment_bytes):
                    yield row(own)
                    no, own = no + 1, None
                own = own or _Open(conv_id)
                if earlier:
                    own.seen.add(digest_of(role, text))
                else:
                    own.seen.discard(digest_of(role, text))
                own.add(turn, role, text)
        if own is not None:
            yield row(own)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return told.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(cut, SEGMENT)


def _costed(segments: DataFrame) -> DataFrame:
    """For each segment and start state the costs of ends (costs) and the order of their least letters (ranks), by one trie a batch;
    for ends of conversations, cost and letters of the last one (closing)."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = batch.column("signature").to_pylist()
            known = {}
            for s, paths in through_trie(signature, (0, 1, 2, 3)):
                costs, ranks, closing = [], [], []
                for layers in paths:
                    ways = [answer(s, layers, end) for end in range(4)]
                    order = {w: k for k, w in enumerate(sorted({w[1] for w in ways}))}
                    costs += [w[0] for w in ways]
                    ranks += [order[w[1]] for w in ways]
                    closing.append(answer(s, layers)[0])
                known[s] = costs, ranks, closing
            keep = [c for c in batch.schema.names if c != "signature"]
            made = [pa.array([known[s][k] for s in signature], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "costs", "ranks", "closing"])

    own = segments.drop("roles", "texts")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.drop("signature").schema.fields)
    return own.mapInArrow(work, f"{fields}, costs array<long>, ranks array<long>, closing array<long>")


CHAINED = "conv_id long, part int, no int, start int, finish int, summary array<long>"


def chained(costs: np.ndarray, ranks: np.ndarray, closing: np.ndarray) -> tuple[int, list[int]]:
    """(cost, the start state of each segment): the cheapest way over segments, ASCII-least. costs, ranks: n x 4 x 4, closing: n x 4."""
    n = len(costs)
    ahead = np.full((n, 4), NEVER, np.int64)  # the least cost from a segment's start state to the conversation's end
    ahead[n - 1] = closing[n - 1]
    for i in range(n - 2, -1, -1):
        ahead[i] = np.minimum(NEVER, costs[i] + ahead[i + 1][None, :]).min(1)
    starts = [0]
    for i in range(n - 1):
        q = starts[-1]
        ends = [e for e in range(4) if costs[i][q][e] < NEVER and costs[i][q][e] + ahead[i + 1][e] == ahead[i][q]]
        starts.append(min(ends, key=lambda e: ranks[i][q][e]))
    return int(ahead[0][0]), starts


def _chain(costed: DataFrame) -> DataFrame:
    """Where each segment begins and ends (-1: at the conversation's end), and, with its first segment, the conversation's numbers."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: list[dict]) -> pa.RecordBatch:
            cost, starts = chained(*(np.array([r[c] for r in rows], np.int64).reshape(len(rows), *shape) for c, shape in (("costs", (4, 4)), ("ranks", (4, 4)), ("closing", (4,)))))
            known = [r for r in rows if r["turns"]]
            distinct = sum(r["turns"] for r in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
            gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - distinct if known else 0
            illegal = sum(r["illegal"] for r in rows) + sum(a["last_role"][:1] + b["first_role"][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
            summary = [gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal, cost]
            columns = [pa.array([r["conv_id"] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.int32()) for c in ("part", "no")), pa.array(starts, pa.int32()), pa.array([*starts[1:], -1], pa.int32()), pa.array([summary, *[None] * (len(rows) - 1)], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "no", "start", "finish", "summary"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    yield settled(held)
                    held = []
                held.append(row)
        if held:
            yield settled(held)

    return costed.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(work, CHAINED)


def _pieces(segments: DataFrame, chain: DataFrame) -> DataFrame:
    """Each segment's letters and its repaired messages as one piece of text (null where it leaves none)."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, pieces = [], []
            rows = batch.select(["signature", "roles", "texts", "start", "finish"]).to_pylist()
            answers = {}
            for start in sorted({r["start"] for r in rows}):
                asked: dict[str, set[int]] = {}
                for r in rows:
                    if r["start"] == start:
                        asked.setdefault(r["signature"], set()).add(r["finish"])
                for s, paths in through_trie(list(asked), (start,)):
                    answers |= {(start, s, e): answer(s, paths[0], None if e < 0 else e)[1] for e in asked[s]}
            for r in rows:
                own = answers[r["start"], r["signature"], r["finish"]]
                said = edited(own, r["roles"], r["texts"], r["start"])
                letters.append(own)
                pieces.append("\n".join(said) if said else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ORDER], batch.column("summary"), pa.array(letters, pa.string()), pa.array(pieces, pa.string())], names=[*ORDER, "summary", "letters", "piece"])

    return segments.join(chain.drop("conv_id"), ["part", "no"]).mapInArrow(work, "conv_id long, part int, no int, summary array<long>, letters string, piece string")


def _whole(pieces: DataFrame) -> DataFrame:
    """One row for each long conversation: its pieces hashed one after the other, as they come."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, own = _schema(), None

        def row(o: tuple) -> pa.RecordBatch:
            conv_id, (*summary, cost), letters, sha, _ = o
            values = (conv_id, *summary, cost, "".join(letters), sha.hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for conv_id, summary, letters, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "summary", "letters", "piece")), strict=True):
                if own is None or summary is not None:
                    if own is not None:
                        yield row(own)
                    own = (conv_id, summary, [], hashlib.sha256(), [False])
                own[2].append(letters)
                if piece is not None:
                    own[3].update((b"\n" if own[4][0] else b"") + piece.encode("utf-8", "surrogatepass"))
                    own[4][0] = True
        if own is not None:
            yield row(own)

    return pieces.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(work, OUT)


def repair(rows: DataFrame, long_rows: int = 4096, long_bytes: int = 1 << 24, segment_rows: int = 1024, segment_bytes: int = 1 << 22, batch_bytes: int = 1 << 24) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows: conv_id, turn, role, text, and gone (rows that only tell that their conversation occurs), as damage() gives them.
    Conversations of more than long_rows messages, or long_bytes of text, are dealt out over tasks.
    """
    size = F.sum(F.octet_length("text").cast("long") + 64)
    sizes = rows.groupBy("conv_id").agg(F.count_if(~F.col("gone")).alias("n"), size.alias("bytes")).filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("conv_id")
    with scratch(rows.sparkSession) as keep:
        large = written(sizes, "long_conversations")
        if large.isEmpty():
            return _short(rows, batch_bytes)
        named = large.withColumnRenamed("conv_id", "long_id")
        same = rows["conv_id"].eqNullSafe(named["long_id"])
        short = rows.join(named, same, "left_anti")
        segments = written(_segments(rows.join(named, same, "left_semi"), segment_rows, segment_bytes), "segments")
        chain = written(_chain(_costed(segments)), "chain")
        pieces = written(_pieces(segments, chain), "pieces")
        keep(large, pieces)
        return _short(short, batch_bytes).unionByName(_whole(pieces))
