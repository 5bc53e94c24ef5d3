"""Source divergence audit: how far the term use of a language's sources is apart, by DuckDB SQL over shards.

Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that at least
`min_docs` of its documents have. Each occurring (language, source) group, and each language, gives a kept term the share
p = 1 + floor(scale * (count + smooth) / (N + smooth * V)), in whole numbers; V is the language's number of kept terms and N the
group's (the language's) occurrences of them. A pair of sources is as far apart as the sum of |p - q| over all kept terms; a
term stands out in a source by p - q against the language.

How it runs: (1) each task counts the terms of its texts by SQL in DuckDB, so that a row for each (language, source, term) leaves
it; (2) those rows are hashed by language and term to shards, sorted there and summed by SQL, some `flush_rows` at a time, cut
between terms: what stays of a shard is its kept terms; (3) the groups' N and V are summed by Spark and sent to every shard;
(4) each shard sums its terms' |p - q| for all pairs of its languages' sources, and ranks its outstanding terms; (5) Spark adds
up the shards' sums and ranks. Pairs of sources are the result itself: a language of S sources has S * (S - 1) rows.

Memory: a task holds about `flush_rows` count rows and `piece_bytes` of text, however long texts are and however many rows a term
or a source has; a single term must fit. DuckDB has one thread and no spill folder in tasks.

Defined results: null text, lang or source is ''; a text without terms still makes its group occur; a language of one source has
no pairs; where no term is kept, values of pairs are 0; ties go by the item's UTF-8 bytes; repeated rows count each time; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, tidied, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
COUNTS = "lang string, source string, term string, n long, docs long"
TOTALS = "shard int, lang string, source string, total long, terms long"

_SEEN = f"""INSERT INTO seen SELECT doc, lang, source, term, count(*) FROM (SELECT doc, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM piece) GROUP BY ALL"""
_COUNTED = """INSERT INTO counted SELECT lang, source, term, sum(n)::BIGINT, count(DISTINCT doc) FROM seen GROUP BY ALL"""
# a group's own row has no term: it occurs, whatever its texts hold
_GROUPS = """INSERT INTO counted SELECT DISTINCT lang, source, NULL, 0, 0 FROM piece"""
_GATHERED = """SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counted GROUP BY ALL"""
_KEPT = """SELECT lang, source, term, n, docs FROM (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS all_docs FROM ({gathered}))
WHERE term IS NULL OR all_docs >= {min_docs}"""

# n and total may be large: products are made in 128 bits
_SHARES = """
CREATE OR REPLACE TEMP TABLE shares AS
WITH langs AS (SELECT lang, sum(total)::HUGEINT AS total, any_value(terms)::HUGEINT AS terms FROM total GROUP BY lang),
terms AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL)
SELECT t.lang, t.term, g.source, coalesce(k.n, 0) AS n,
  1 + ({scale}::HUGEINT * (coalesce(k.n, 0) + {smooth})) // (g.total + {smooth} * g.terms::HUGEINT) AS p,
  1 + ({scale}::HUGEINT * (t.n + {smooth})) // (l.total + {smooth} * l.terms) AS q
FROM terms t JOIN langs l ON t.lang = l.lang JOIN total g ON t.lang = g.lang
LEFT JOIN kept k ON k.lang = t.lang AND k.term = t.term AND k.source = g.source"""
_PAIRS = """
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL
SELECT a.lang, a.source, 'pair', b.source, 0 FROM total a JOIN total b ON a.lang = b.lang AND a.source < b.source WHERE a.terms = 0 AND a.first"""
_TERMS = """
SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {ranks}"""


def _duckdb(memory: str):
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": "", "preserve_insertion_order": False})


def pieces(texts: list[str], size: int) -> Iterator[tuple[int, str]]:
    """(row, piece): texts cut between terms into pieces of `size` characters or little more."""
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at > size:
            end = _BETWEEN.search(text, at + size)
            if end is None:
                break
            yield row, text[at : end.start()]
            at = end.start()
        yield row, text[at:] if at else text


def _runs(batch: pa.RecordBatch, size: int) -> Iterator[pa.Table]:
    """The batch's rows as tables (doc, lang, source, text) of about `size` characters each; doc is the row's place."""
    doc, texts, length = [], [], 0
    lang, source = batch.column("lang"), batch.column("source")

    def table() -> pa.Table:
        at = pa.array(doc, pa.int64())
        return pa.table({"doc": at, "lang": lang.take(at), "source": source.take(at), "text": pc.ascii_lower(pa.array(texts, pa.large_string()))})

    for row, text in pieces(batch.column("text").to_pylist(), size):
        doc.append(row)
        texts.append(text)
        length += len(text)
        if length >= size:
            yield table()
            doc, texts, length = [], [], 0
    if doc:
        yield table()


def counts(docs: DataFrame, flush_rows: int = 400_000, piece_bytes: int = 1 << 22, memory: str = "400MB") -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents by task; a row without a term for each group."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb(memory)
        con.execute("CREATE TABLE seen (doc BIGINT, lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
        con.execute("CREATE TABLE counted (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        held = 0
        for batch in batches:
            for run in _runs(batch, piece_bytes):
                con.register("piece", run)
                held += con.execute(_SEEN).fetchone()[0]
                con.execute(_GROUPS)
                con.unregister("piece")
            # documents are whole in a batch, so they are counted once
            con.execute(_COUNTED)
            con.execute("TRUNCATE seen")
            if held >= flush_rows:
                yield from con.execute(_GATHERED).to_arrow_reader(1 << 16)
                con.execute("TRUNCATE counted")
                held = 0
        yield from con.execute(_GATHERED).to_arrow_reader(1 << 16)
        con.close()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(blank("text"), blank("lang"), blank("source")).mapInArrow(count, COUNTS)


def kept_terms(counted: DataFrame, min_docs: int = 30, flush_rows: int = 400_000, memory: str = "400MB") -> DataFrame:
    """lang, source, term, n, docs of terms that enough documents of the language have, and each group's row without a term."""

    @tidied
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb(memory)
        kept = _KEPT.format(gathered=_GATHERED, min_docs=int(min_docs))

        def whole(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            con.register("counted", pa.Table.from_batches(tables))
            yield from con.execute(kept).to_arrow_reader(1 << 16)
            con.unregister("counted")

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows are sorted: where the last term of the batch begins, all before it are complete
            same = pc.and_(*[pc.fill_null(pc.equal(batch.column(c), batch.column(c)[-1]), batch.column(c)[-1].as_py() is None) for c in ("lang", "term")])
            cut = pc.index(same, True).as_py()
            if rows + cut >= flush_rows and cut:
                yield from whole([*held, batch.slice(0, cut)])
                held, rows = [batch.slice(cut)], batch.num_rows - cut
            else:
                held.append(batch)
                rows += batch.num_rows
                if rows >= 2 * flush_rows:  # one term's rows alone: they become one for each source
                    con.register("counted", pa.Table.from_batches(held))
                    held = con.execute(_GATHERED + " ORDER BY lang, term NULLS FIRST").to_arrow_table().combine_chunks().to_batches()
                    con.unregister("counted")
                    rows = sum(b.num_rows for b in held)
        if held:
            yield from whole(held)
        con.close()

    return counted.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(keep, COUNTS)


def group_totals(kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), terms (the language's number of kept terms) of each occurring group."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.filter(F.col("term").isNotNull()).select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    return groups.join(terms, "lang", "left").select("lang", "source", "total", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))


def _compared(kept: DataFrame, totals: DataFrame, shards: int, smooth: int, ranks: int, scale: int, memory: str) -> DataFrame:
    """Partial sums of pairs (both ways) and outstanding terms of every shard: lang, source, part, item, value."""

    @tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb(memory)
        con.execute("CREATE TABLE got (shard INTEGER, lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, terms BIGINT)")
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            con.execute("INSERT INTO got SELECT * FROM batch")
            con.unregister("batch")
        con.execute("CREATE TEMP TABLE kept AS SELECT lang, source, term, n FROM got WHERE term IS NOT NULL")
        # several shards may share a task: each has sent the same totals
        con.execute("CREATE TEMP TABLE total AS SELECT lang, source, any_value(n) AS total, any_value(terms) AS terms, min(shard) = 0 AS first FROM got WHERE term IS NULL GROUP BY ALL")
        con.execute(_SHARES.format(scale=scale, smooth=smooth))
        con.execute(f"CREATE TEMP TABLE pairs AS {_PAIRS}")
        both = f"SELECT * FROM pairs UNION ALL SELECT lang, item AS source, part, source AS item, value FROM pairs UNION ALL ({_TERMS.format(ranks=ranks)})"
        yield from con.execute(both).to_arrow_reader(1 << 16)
        con.close()

    own = kept.filter(F.col("term").isNotNull()).select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "lang", "source", "term", "n", F.lit(0).cast("long").alias("terms"))
    sent = totals.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "terms")
    return own.unionByName(sent).repartition(shards, "shard").mapInArrow(compare, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, min_docs: int = 30, smooth: int = 5, ranks: int = 50, scale: int = 1_000_000_000, flush_rows: int = 400_000, piece_bytes: int = 1 << 22, memory: str = "400MB") -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance to every other one of its language (part pair, item the other
    source), and the terms by which it stands out (part term, the first `ranks`)."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark) as keep:
        kept = written(kept_terms(counts(docs, flush_rows, piece_bytes, memory), min_docs, flush_rows, memory), "kept_terms")
        keep(kept)
    found = _compared(kept, group_totals(kept), shards, smooth, ranks, scale, memory)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.filter("part = 'term'")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= ranks)).select("lang", "source", "part", "item", "value", "rank")
