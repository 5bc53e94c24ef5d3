"""Array work that stays in proportion to the array: values bound once, folds that emit, and look-ups by sorting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a fold appends to one array before it begins another: appending copies the array.
BLOCK = 256


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with a number where df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use refers to it (through an array of one). What a lambda function
    refers to has to be bound so: a column that a plan folds into the lambda function is worked out for each element."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def scan(items: Column, start: Column, state_of: Callable[[Column, Column], Column], out_of: Callable[[Column, Column], Column], out: str) -> Column:
    """struct(state, out): a fold in order, where each item changes the state and, by the state before it, gives an array; all of
    these (of type `out`) in one. In blocks, so that appending costs BLOCK for each item, not their number."""
    none = F.array().cast(out)
    one = lambda acc, x: F.struct(state_of(acc.state, x).alias("state"), F.concat(acc.out, out_of(acc.state, x)).alias("out"))
    block = lambda acc, xs: F.aggregate(xs, F.struct(acc.state.alias("state"), none.alias("out")), one, lambda d: F.struct(d.state.alias("state"), F.array_append(acc.out, d.out).alias("out")))
    begin = F.struct(start.alias("state"), F.array().cast(f"array<{out}>").alias("out"))
    done = lambda acc: F.struct(acc.state.alias("state"), F.flatten(acc.out).alias("out"))
    cut_up = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
    return F.aggregate(once(items, lambda xs: F.when(F.size(xs) <= BLOCK, F.array(xs)).otherwise(cut_up(xs))), begin, block, done)


def looked_up(keys: Column, table: Column) -> Column:
    """For each of the keys (strings) the value of the table's first entry (k, v: strings) with that key, or null: one sort of both."""
    return once(F.struct(keys.alias("keys"), table.alias("table")), lambda x: _looked_up(x["keys"], x["table"]))


def _looked_up(keys: Column, table: Column) -> Column:
    n = F.size(table)
    both = F.concat(
        F.transform(table, lambda e, i: F.struct(e.k.alias("k"), (i - n).alias("at"), e.v.alias("v"))),
        F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("at"), F.lit(None).cast("string").alias("v"))),
    )
    start = F.struct(F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v"))
    first = lambda s, x: F.when(x.k == s.k, s).otherwise(F.struct(x.k.alias("k"), x.v.alias("v")))
    answer = lambda s, x: F.struct(x.at.alias("at"), F.when(x.k == s.k, s.v).otherwise(x.v).alias("v"))
    found = "array<struct<at:int,v:string>>"
    asked = scan(F.sort_array(both), start, first, lambda s, x: F.when(x.at >= 0, F.array(answer(s, x))).otherwise(F.array().cast(found)), found).out
    return F.transform(F.sort_array(asked), lambda x: x.v)


def cutter(text: Column) -> Column:
    """What cut() takes pieces from without walking the text: its bytes where each character has one, else four for each."""
    plain = F.octet_length(text) == F.length(text)
    return F.struct(F.when(plain, text.cast("binary")).otherwise(F.encode(text, "UTF-32")).alias("raw"), F.when(plain, 1).otherwise(4).alias("unit"))


def cut(c: Column, start: Column, length: Column) -> Column:
    """length characters from start (0-based) of what c was made of."""
    piece = F.substring(c.raw, c.unit * start + 1, c.unit * length)
    # one character before the piece, dropped again: decoding would take a U+FEFF in front for a byte order mark
    wide = F.substring(F.decode(F.concat(F.lit(b"\x00\x00\x00x"), piece), "UTF-32"), F.lit(2), length)
    return F.when(c.unit == 1, piece.cast("string")).otherwise(wide)
