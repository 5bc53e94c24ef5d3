"""A training corpus from documents in five stages: language, near copies, benchmark leaks, mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Rows are dropped by the first three stages only, and only those that they
reject; the fourth sets the order of the rows, which the fifth follows in its files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloaklake.llm import decontaminate, language_id, ngram_join, pfair_mix, token_files
from cloaklake.llm.shared import scratch, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without text (null or empty) or without any letter go.

    Each row is judged by its own text: rows that repeat a doc_id or lack one are treated alike. Long texts are read whole. An
    empty table stays empty. All columns come through as they are, whatever their names.
    """
    model = language_id.learn(docs)
    carried = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = language_id.identify(docs, model, {n: F.col(f"`{c}`") for c, n in carried.items()}, keep_text=True)
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*[F.col(carried.get(c, c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity of 0.75 or more links: that of the smallest doc_id.

    Rows are told apart by doc_id and text, so another text under the same doc_id, or under none, is judged on its own; of rows
    that repeat both, one stays. Texts without words link with nothing. An empty table stays empty. All columns come through.
    """
    return ngram_join.without_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Each row is judged by its own text, whatever other rows have its doc_id, or none; null and empty texts hold nothing and stay;
    repeated rows stay or go together. With an empty table on either side nothing goes. All columns come through.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the schedule mixes their sources.

    A null source is a source of its own; a null size (n_chars) counts 0; repeated rows and rows without doc_id each have their
    place. An empty table stays empty. All columns come through.
    """
    return pfair_mix.in_mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the token files; the files follow the order of docs' files, which the
    mixture set (part, then row), or doc_id where docs come from elsewhere.

    A null or empty text has just the end id; repeated rows and null doc_ids each have their row; long texts are encoded whole; an
    empty table gives an empty result; other columns are ignored.
    """
    try:
        part = F.regexp_extract("_metadata.file_name", r"^part-([0-9]+)", 1)
        placed = docs.select("doc_id", "text", F.when(part != "", part).cast("long").alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        order = ["part", "file", "row"]
    except AnalysisException:  # not files
        placed, order = docs.select("doc_id", "text"), None
    return token_files.token_corpus(placed, public_tokenizers.path("byte_bpe_50k.json"), order=order)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", leaks), ("mixing sources", mixture), ("token files", tokens)]

#: Language models, components and tokens have no SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        keep(docs)
    return docs
