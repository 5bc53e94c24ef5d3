"""Text spans of requests, and texts put back into them.

A span is (request_id, span_ord, path, message_idx, part_idx, nested_idx, role, text), in the order of the request.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..sources.requests import get, kind_of

SPAN = "request_id string, span_ord int, path string, message_idx int, part_idx int, nested_idx int, role string, text string"
KEYS = ["message_idx", "part_idx", "nested_idx"]
LIST = "array<struct<path:string,message_idx:int,part_idx:int,nested_idx:int,role:string,text:string>>"


def _read(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _span(path: Column, message: Column, part: Column, nested: Column, role: Column, text: Column) -> Column:
    return F.struct(path.alias("path"), message.alias("message_idx"), part.alias("part_idx"), nested.alias("nested_idx"), role.alias("role"), text.alias("text"))


def _own(v: Column, made: Callable[[Column], Column]) -> Column:
    """An array of the span of a string; an empty one if v isn't one."""
    return F.when(_is_text(v), F.array(made(_read(v, "$", "string")))).otherwise(F.array().cast(LIST))


def _listed(content: Column, spans: Callable[[Column, Column], Column]) -> Column:
    """The spans of a content's parts, in their order; null if it is no list."""
    return F.flatten(F.transform(_read(content, "$", "array<variant>"), spans))


def _spans_of(content: Column, at: Column, message: Column, role: Column, parts: Callable[[Column, Column], Column]) -> Column:
    whole = _own(content, lambda t: _span(at, message, F.lit(0), F.lit(None).cast("int"), role, t))
    return F.coalesce(_listed(content, parts), whole)


def _in_messages(spans: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """The spans of all messages: spans(content, path, message_idx, role)."""
    path = lambda i: F.concat(F.lit("messages["), i.cast("string"), F.lit("].content"))
    return F.coalesce(F.flatten(F.transform("messages", lambda m, i: spans(_read(m, "$.content"), path(i), i, _read(m, "$.role", "string")))), F.array().cast(LIST))


def _at(path: Column, i: Column, tail: str) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]" + tail))


def _list_a() -> Column:
    def part(path: Column, i: Column, role: Column, b: Column, j: Column) -> Column:
        own = lambda v: _own(v, lambda t: _span(_at(path, j, ".text"), i, j, F.lit(None).cast("int"), role, t))
        return F.when(_read(b, "$.type", "string") == "text", own(_read(b, "$.text"))).otherwise(F.array().cast(LIST))

    return _in_messages(lambda c, path, i, role: _spans_of(c, path, i, role, lambda b, j: part(path, i, role, b, j)))


def _blocks_b(path: Column, i: Column, role: Column) -> Callable[[Column, Column], Column]:
    """Texts of blocks: text, thinking, tool results (role tool) as a string or as text children, one level down."""
    none, tool, nothing = F.lit(None).cast("int"), F.lit("tool"), F.array().cast(LIST)

    def child(j: Column, x: Column, k: Column) -> Column:
        own = lambda v: _own(v, lambda t: _span(F.concat(_at(path, j, ".content["), k.cast("string"), F.lit("].text")), i, j, k, tool, t))
        return F.when(_read(x, "$.type", "string") == "text", own(_read(x, "$.text"))).otherwise(nothing)

    def block(b: Column, j: Column) -> Column:
        named = lambda name: _own(_read(b, f"$.{name}"), lambda t: _span(_at(path, j, f".{name}"), i, j, none, role, t))
        flat = lambda c: _own(c, lambda t: _span(_at(path, j, ".content"), i, j, none, tool, t))
        result = lambda c: F.coalesce(_listed(c, lambda x, k: child(j, x, k)), flat(c))
        kind = lambda t: F.when(t == "text", named("text")).when(t == "thinking", named("thinking")).when(t == "tool_result", result(_read(b, "$.content"))).otherwise(nothing)
        return once(_read(b, "$.type", "string"), kind)

    return block


def _list_b() -> Column:
    of = lambda c, path, i, role: _spans_of(c, path, i, role, _blocks_b(path, i, role))
    system = of(_read(F.col("request"), "$.system"), F.lit("system"), F.lit(-1), F.lit("system"))
    return F.filter(F.concat(F.coalesce(system, F.array().cast(LIST)), _in_messages(of)), lambda x: x.text != "")


def span_list(dialect: str) -> Column:
    """Of a parsed request all spans as an array, in their order: struct(path, message_idx, part_idx, nested_idx, role, text). A request is one row,
    and its spans are made in it, in one pass and without an exchange.

    Dialect A: whole contents (also empty ones), and text parts of part lists; other parts, nulls and absent contents have none.
    Dialect B: the system text first (message_idx -1), then messages; empty texts have no span.
    """
    return {"A": _list_a, "B": _list_b}[dialect]()


def _spans(requests: DataFrame, dialect: str) -> DataFrame:
    # the list is no column of its own: of one, Spark would make a filter that it pushes before the table is dealt out, and make the list twice
    out = requests.select("request_id", F.posexplode(span_list(dialect)).alias("span_ord", "x"))
    return out.select("request_id", "span_ord", "x.path", "x.message_idx", "x.part_idx", "x.nested_idx", "x.role", "x.text")


def spans_a(requests: DataFrame) -> DataFrame:
    """The spans of dialect A, a row each."""
    return _spans(requests, "A")


def spans_b(requests: DataFrame) -> DataFrame:
    """The spans of dialect B, a row each."""
    return _spans(requests, "B")


def spans_text(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Plain texts: one span each."""
    none = F.lit(None).cast("int")
    return df.select(F.col(key).cast("string").alias("request_id"), F.lit(0).alias("span_ord"), F.lit("text").alias("path"), F.lit(0).alias("message_idx"), F.lit(0).alias("part_idx"), none.alias("nested_idx"), F.lit(None).cast("string").alias("role"), F.col(text).alias("text"))


EXTRACTORS = {"A": spans_a, "B": spans_b}


def joined_text(spans: DataFrame) -> DataFrame:
    """request_id, text: the texts of messages (not of system), joined by line breaks in their order."""
    own = F.array_sort(F.collect_list(F.when(F.col("message_idx") >= 0, F.struct("span_ord", "text"))))
    return spans.groupBy("request_id").agg(F.array_join(F.transform(own, lambda x: x.text), "\n").alias("text"))


def text_of(content: Column) -> Column:
    """A content's text: a string, or its text parts joined by line breaks; else empty."""
    parts = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda p: (F.try_variant_get(p, "$.type", "string") == "text") & (kind_of(F.try_variant_get(p, "$.text", "variant")) == "STRING"))
    listed = F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), "\n")
    return F.when(kind_of(content) == "STRING", F.try_variant_get(content, "$", "string")).when(kind_of(content) == "ARRAY", listed).otherwise("")


def block_text(block: Column, depth: int = 2) -> Column:
    """A block's text: text or thinking; of tool results the string or the children's texts joined, empty ones left out; else empty."""
    kind = F.try_variant_get(block, "$.type", "string")
    content = F.try_variant_get(block, "$.content", "variant")
    children = F.lit("")
    if depth:
        texts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda x: block_text(x, depth - 1))
        children = F.array_join(F.filter(texts, lambda t: t != ""), "\n")
    tool = F.when(kind_of(content) == "STRING", F.try_variant_get(content, "$", "string")).when(kind_of(content) == "ARRAY", children)
    out = F.when(kind == "text", F.try_variant_get(block, "$.text", "string")).when(kind == "thinking", F.try_variant_get(block, "$.thinking", "string")).when(kind == "tool_result", tool)
    return F.coalesce(out, F.lit(""))


def content_text_b(content: Column) -> Column:
    """A string, or the texts of blocks joined by line breaks, empty ones left out."""
    texts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: block_text(b)), lambda t: t != "")
    return F.when(kind_of(content) == "STRING", F.try_variant_get(content, "$", "string")).when(kind_of(content) == "ARRAY", F.array_join(texts, "\n")).otherwise("")


def log_text(requests: DataFrame, dialect: str, *also: str) -> DataFrame:
    """request_id, the columns `also`, log_text: a line `[role] text` for each message, `[role multimodal]` for part lists in A; in B `[system]` first."""
    role = lambda m: F.try_variant_get(m, "$.role", "string")
    content = lambda m: F.try_variant_get(m, "$.content", "variant")
    if dialect == "A":
        tag = lambda m: F.when(kind_of(content(m)) == "ARRAY", F.concat(F.lit("["), role(m), F.lit(" multimodal] "))).otherwise(F.concat(F.lit("["), role(m), F.lit("] ")))
        lines = F.transform("messages", lambda m: F.concat(tag(m), text_of(content(m))))
    else:
        own = F.transform("messages", lambda m: F.concat(F.lit("["), role(m), F.lit("] "), content_text_b(content(m))))
        system = content_text_b(get("request", "$.system"))
        lines = F.when(system != "", F.concat(F.array(F.concat(F.lit("[system] "), system)), own)).otherwise(own)
    return requests.select("request_id", *also, F.array_join(lines, "\n").alias("log_text"))


def _put(body: dict, dialect: str, span: dict) -> None:
    i, j, k = span["message_idx"], span["part_idx"], span["nested_idx"]
    owner, key = (body, "system") if i == -1 else (body["messages"][i], "content")
    content = owner.get(key)
    if isinstance(content, str):
        owner[key] = span["text"]
    elif isinstance(content, list) and j < len(content):
        block = content[j]
        if k is not None and not pd.isna(k):
            block["content"][int(k)]["text"] = span["text"]
        else:
            block[{"thinking": "thinking", "tool_result": "content"}.get(block.get("type"), "text") if dialect == "B" else "text"] = span["text"]


def with_texts(requests: DataFrame, spans: DataFrame, dialect: str, body: str = "body") -> DataFrame:
    """request_id, body with the texts of spans in place of those at their (message, part, nested) places; all else stays.

    JSON trees of open shape have no built-in update, so bodies are rebuilt in Arrow batches.
    """
    lists = spans.groupBy("request_id").agg(F.collect_list(F.struct(*KEYS, "text")).alias("_spans"))
    return rebuilt(requests.select("request_id", F.col(body).alias("body")).join(lists, "request_id", "left"), dialect)


def rebuilt(df: DataFrame, dialect: str, also: str | None = None) -> DataFrame:
    """request_id, body and the string column `also` of df, which has the spans to put in as _spans (array, or null for none)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for b, s in zip(f["body"], f["_spans"], strict=True):
                if s is not None and len(s):
                    tree = json.loads(b)
                    for x in s:
                        _put(tree, dialect, x)
                    b = json.dumps(tree, ensure_ascii=False, separators=(",", ":"))
                out.append(b)
            yield f.drop(columns="_spans").assign(body=out)

    kept = ["request_id", "body", *([also] if also else [])]
    return df.select(*kept, "_spans").mapInPandas(work, ", ".join(f"{c} string" for c in kept))
