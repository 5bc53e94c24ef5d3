"""Server-sent event lines: taken apart into columns, and put together again. One row is one whole line (stream_id, seq, line);
bodies, or chunks of them, are taken apart into lines, and lines put together to bodies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PREFIX = "data: "
DONE = "[DONE]"


def read_bodies(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """stream_id, seq, line of raw event streams: each file of a folder is one stream's body, its name the stream's id."""
    source = (spark.readStream if streaming else spark.read).format("text").option("wholetext", True)
    if streaming:
        source = source.schema("value string")
    return lines_of(source.load(path).select(F.col("_metadata.file_name").alias("stream_id"), F.col("value").alias("body")))


def lines_of(bodies: DataFrame) -> DataFrame:
    """stream_id, seq, line of bodies (stream_id, body). Lines end with a line break; empty ones, which only separate events, are left
    out. seq counts those that stay, from 0."""
    rows = bodies.select("stream_id", F.posexplode(F.filter(F.split("body", "\r?\n"), lambda x: x != "")).alias("seq", "line"))
    return rows.withColumn("seq", F.col("seq").cast("long"))


class Framer:
    """Lines out of chunks of bytes: carry is the unfinished one. Empty lines are left out; bytes that aren't UTF-8 become U+FFFD."""

    def __init__(self, carry: bytes = b""):
        self.carry = carry

    def feed(self, chunk: bytes) -> list[str]:
        """The lines that the chunk finishes."""
        *whole, self.carry = (self.carry + chunk).split(b"\n") if b"\n" in chunk else (self.carry + chunk,)
        return [x.decode("utf-8", "replace") for w in whole if (x := w.removesuffix(b"\r"))]

    def end(self) -> list[str]:
        """The unfinished line, if it isn't empty."""
        rest, self.carry = self.carry, b""
        return [rest.decode("utf-8", "replace")] if rest else []


def lines_of_chunks(chunks: DataFrame) -> DataFrame:
    """stream_id, seq, line of finished streams' chunks (stream_id, n, chunk: binary or string) as they came over the wire: a line,
    and a character, may be split over chunks anywhere. Streams lie whole and in order in partitions; a task holds a batch of chunks
    and one line. Of chunks with one n the first by its bytes counts; a null chunk is an empty one."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        framer, key, last, seq = Framer(), None, None, 0
        for frame in frames:
            rows = []
            for stream_id, n, chunk in zip(frame["stream_id"], frame["n"], frame["chunk"], strict=True):
                if (stream_id, n) == (key, last):
                    continue
                if stream_id != key:
                    rows += [(key, seq + i, x) for i, x in enumerate(framer.end())]
                    framer, key, seq = Framer(), stream_id, 0
                for x in framer.feed(b"" if chunk is None else bytes(chunk)):
                    rows.append((key, seq, x))
                    seq += 1
                last = n
            yield pd.DataFrame(rows, columns=["stream_id", "seq", "line"])
        yield pd.DataFrame([(key, seq, x) for x in framer.end()], columns=["stream_id", "seq", "line"])

    own = chunks.filter("stream_id IS NOT NULL AND n IS NOT NULL").select(F.col("stream_id").cast("string").alias("stream_id"), F.col("n").cast("long").alias("n"), F.col("chunk").cast("binary").alias("chunk"))
    return own.repartition("stream_id").sortWithinPartitions("stream_id", "n", "chunk").mapInPandas(work, "stream_id string, seq long, line string")


def bodies_of(lines: DataFrame, dialect: str) -> DataFrame:
    """stream_id, body: each stream's lines in order, as they go over the wire. lines: stream_id, seq, line, and part where an event gave several."""
    order = ["seq", *(["part"] if "part" in lines.columns else []), "line"]
    own = F.array_sort(F.collect_list(F.struct(*order)))
    return lines.groupBy("stream_id").agg(F.array_join(F.transform(own, lambda x: framed(x.line, dialect)), "").alias("body"))


def write_lines(lines: DataFrame, path: str, dialect: str, checkpoint: str) -> StreamingQuery:
    """A streaming sink: a folder for each stream, to which each micro-batch adds its lines as they go over the wire."""
    whole = framed(F.col("line"), dialect)
    value = F.substring(whole, F.lit(1), F.length(whole) - 1)  # the text sink ends each value with a line break
    return lines.select("stream_id", value.alias("value")).writeStream.format("text").partitionBy("stream_id").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON rows stream_id, seq, line from the files of a folder."""
    return spark.readStream.schema("stream_id string, seq long, line string").json(path)


def parsed(lines: DataFrame) -> DataFrame:
    """lines with data (what follows the prefix), is_done, and event (variant; null where data isn't JSON)."""
    data = F.when(F.startswith("line", F.lit(PREFIX)), F.substring("line", len(PREFIX) + 1, 1 << 30))
    out = lines.withColumn("data", data)
    return out.withColumns({"is_done": F.coalesce(F.col("data") == DONE, F.lit(False)), "event": F.try_parse_json("data")})


def delta_text(event: Column | str, dialect: str) -> Column:
    """The piece of text that an event adds; null for other events."""
    if dialect == "A":
        return F.try_variant_get(event, "$.choices[0].delta.content", "string")
    kind = F.try_variant_get(event, "$.type", "string") == "content_block_delta"
    inner = F.try_variant_get(event, "$.delta.type", "string") == "text_delta"
    return F.when(kind & inner, F.try_variant_get(event, "$.delta.text", "string"))


def framed(line: Column, dialect: str) -> Column:
    """A line with its terminator: an empty line after each event in A, a line break in B."""
    return F.when(F.startswith(line, F.lit(PREFIX)) & F.lit(dialect == "A"), F.concat(line, F.lit("\n\n"))).otherwise(F.concat(line, F.lit("\n")))
