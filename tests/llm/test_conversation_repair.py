"""Repair held against a search through all edits, and its two ways (whole and dealt out) against each other."""

import hashlib
import itertools
import random
import zlib

import pytest

from cloaklake.llm import conversation_repair as cr
from cloaklake.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def right(roles: str) -> bool:
    roles = roles.removeprefix("s") if roles.startswith("s") else roles
    return not roles or (roles == "ua" * (len(roles) // 2))


def all_ways(signature: str, most: int):
    """(cost, letters) of every way to a right sequence with at most `most` inserts, by brute force."""
    for letters in itertools.product("DKR", repeat=len(signature)):
        for n in range(most + 1):
            for places in itertools.combinations_with_replacement(range(len(signature) + 1), n):
                own = [*letters]
                for p in sorted(places, reverse=True):
                    own.insert(p, "I")
                yield "".join(own)


def cost_of(signature: str, letters: str, start: str = "") -> int | None:
    roles, cost, row = start, 0, 0
    for letter in letters:
        symbol = signature[row] if letter != "I" and row < len(signature) else ""
        row += letter != "I"
        if letter == "D":
            cost += 4
            continue
        if symbol == "x":
            return None
        cost += 3 if symbol.isupper() else 0
        if letter == "K":
            if symbol.lower() == "o":
                return None
            roles += symbol.lower()
        else:
            cost += 3
            roles += "a" if roles.endswith("u") else "u"
    ok = right(roles) and not (roles == "s")
    return cost if ok else None


@pytest.mark.parametrize("seed", range(6))
def test_answers_equal_a_search_through_all_edits(seed):
    rng = random.Random(seed)
    signatures = {"".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(0, 4))) for _ in range(25)}
    for signature, paths in cr.through_trie(sorted(signatures)):
        cost, letters, _ = cr.answer(signature, paths[0])
        best = min((c, w) for w in all_ways(signature, 4) if (c := cost_of(signature, w)) is not None)
        assert (cost, letters) == best, signature


def test_shared_prefixes_give_the_same_as_each_alone():
    rng = random.Random(9)
    signatures = ["".join(rng.choice("suaUAx") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    together = {s: cr.answer(s, p[0]) for s, p in cr.through_trie(signatures)}
    for s in signatures:
        [(_, alone)] = list(cr.through_trie([s]))
        assert cr.answer(s, alone[0]) == together[s]


def expected(rows):
    """The contract's columns by plain Python, for small conversations."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv and not r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text, _ in own:
            left = text.rstrip(" \t\n\v\f\r")
            faults.append("B" if not left else "D" if (role, text) in seen else "" if left[-1] in ".!?" else "T")
            seen.add((role, text))
        signature = "".join(cr.symbol_of(r[2], f) for r, f in zip(own, faults, strict=True))
        cost, letters = min((c, w) for w in all_ways(signature, 4) if (c := cost_of(signature, w)) is not None)
        said = "\n".join(cr.edited(letters, [r[2] for r in own], [r[3] for r in own]))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, *(faults.count(f) for f in "BDT"), illegal, cost, letters, hashlib.sha256(said.encode()).hexdigest())
    return out


def random_rows(rng, convs, most):
    text = ["Hi.", "So it is!", "cut off", "", " \n", "Why?", "é…", "two\nlines."]
    return [(c if c else None, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "", " "]), rng.choice(text), rng.random() < 0.1) for c in range(convs) for _ in range(rng.randint(1, most))]


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_equals_plain_python(spark):
    rows = random_rows(random.Random(1), 40, 5)
    df = spark.createDataFrame(rows, SCHEMA + ", gone boolean")
    assert got(cr.repair(df)) == expected(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_dealt_out_conversations_give_the_same(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 12, 60) + [(99, 3, "user", "Same.", False)] * 50
    df = spark.createDataFrame(rows, SCHEMA + ", gone boolean").repartition(3)
    whole = got(cr.repair(df))
    assert len(whole) == 13
    assert got(cr.repair(df, long_rows=4, segment_rows=3)) == whole
    assert got(cr.repair(df, long_rows=20, segment_rows=7)) == whole
    assert got(cr.repair(df, long_bytes=900, segment_bytes=150)) == whole


def test_damage_by_hash(spark):
    rows = [(c, t, "assistant", f"a.{t}! b?") for c in range(30) for t in range(8)]
    damaged = cr.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        own = [(r.role, r.text, r.gone) for r in damaged if (r.conv_id, r.turn) == (c, t)]
        want = {0: [(role, text, True)], 1: [(role, "", False)], 2: [(role, f"a{t} b", False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}
        assert own == want.get(kind, [(role, text, False)])


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (7, None, "user", "Hi."), (7, 2, "assistant", None), (8, 1, "assistant", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS Signature", "2 AS `CONV`", "3 AS gone")
    out = got(cr.repair(cr.damage(df)))
    assert set(out) == {None, 7, 8}
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair(cr.damage(empty)).collect() == []
    only_gone = spark.createDataFrame([(1, 1, "user", "Hi.", True)], SCHEMA + ", gone boolean")
    assert got(cr.repair(only_gone)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_returns_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op11_conversation_repair(spark, sf).count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
