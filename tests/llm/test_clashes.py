"""Columns of the input that are named like anything the operators use inside: nothing fails, and they come out as they went in."""

import pytest
from pyspark.sql import functions as F

from cloaklake.llm import ann_search, decontaminate, language_id, licence_scan, lm_score, ngram_join, pfair_mix, url_filter, warc_store
from cloaklake.llm.queries import PIECES, public_tokenizers
from cloaklake.llm.shared import fresh_path

NAMES = """_own _src _range _h _units _k _j _slot _release _deadline _sum _before _in _key _no leak gone best host_len path_len short digest whole
lang_pred score block slot release deadline at label g n set own component_id verdict rule host path hs words size row_id keys times train
held_out sha256 payload address keeper url html v h part leader q found rank s.t""".split()


def cluttered(df):
    have = set(df.columns)
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in NAMES if c not in have])


@pytest.fixture
def docs(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, "the licence is the MIT License", "en", "b"), (1, "other words here " * 9, "de", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


def test_kept_rows_keep_their_columns(spark, docs):
    own = cluttered(docs)
    items = cluttered(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string"))
    left = ngram_join.without_copies(own)
    assert left.columns == own.columns and left.count() == 5
    clean = decontaminate.without_leaks(own, items)
    assert clean.columns == own.columns and clean.count() == 4
    order = pfair_mix.in_mixed_order(own)
    assert order.columns == own.columns and order.count() == 6
    for df in (left, clean, order):
        assert all(r[c] == f"mine {c}" for r in df.collect() for c in NAMES if c not in docs.columns)
    mixed = pfair_mix.mix(own)
    assert all(r[c] == f"mine {c}" for r in mixed.collect() for c in NAMES if c not in docs.columns and c not in pfair_mix.NEW)


def test_operators_take_no_notice(spark, docs):
    own = cluttered(docs)
    path = public_tokenizers.path(PIECES)
    for f in (licence_scan.scan_licences, language_id.language_id, ngram_join.ngram_join, lambda d: lm_score.score_documents(d, path), lambda d: decontaminate.find_leaks(d, docs.select(F.col("doc_id").alias("item_id"), "text"))):
        assert sorted(map(str, f(own).collect())) == sorted(map(str, f(docs).collect()))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    assert sorted(map(str, ann_search.nearest(cluttered(vectors)).collect())) == sorted(map(str, ann_search.nearest(vectors).collect()))
    pages = spark.createDataFrame([(1, "http://a.net/x", "p"), (2, None, None), (3, "http://a.org/fr/", "p")], "page_id long, url string, html string")
    judged = url_filter.judge_urls(cluttered(pages))
    assert [r.verdict for r in judged.orderBy("page_id").collect()] == ["block", "allow", "allow"] and {r.best for r in judged.collect()} == {"mine best"}
    records = warc_store.page_records(spark, warc_store.write_archive(cluttered(pages), fresh_path(spark, "clash")))
    assert [(r.page_id, r.record_type) for r in records.orderBy("page_id").collect()] == [(1, "revisit"), (2, "response"), (3, "response")]


def test_pipeline_stages(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "no such words in any document at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = cluttered(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, str(tmp_path))
        assert out.columns == own.columns, name
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in NAMES if c not in docs.columns), name
    assert corpus_pipeline.STAGES[-1][1](spark, own, str(tmp_path)).count() == 6
