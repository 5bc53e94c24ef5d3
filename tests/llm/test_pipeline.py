import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from cloaklake.llm import pfair_mix

from ..conftest import DATA
from .test_leaks_and_mix import brute as leaks_of
from .test_ngram_join import brute as components_of


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    base = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    extra = [(10_000, None, "en", "s", 0), (10_001, "123 -- 456", "en", "s", 10), (10_002, "", "de", None, None)]
    base.unionByName(spark.createDataFrame(extra, base.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}").orderBy("start").collect()
    docs = [r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect() if any(c.isalpha() for c in r.text or "")]
    least = {i: c for i, _, c in components_of([(r.doc_id, r.text) for r in docs])}
    docs = [r for r in docs if least[r.doc_id] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks_of([(r.doc_id, r.text) for r in docs], items)}
    docs = {r.doc_id: r for r in docs if r.doc_id not in bad}
    assert {r.doc_id for r in got} == docs.keys() and len(got) == len(docs)
    order = pfair_mix.mix(spark.createDataFrame(list(docs.values()), base.schema)).orderBy("slot", "at", "doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in order]
    whole, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in got:
        ids = np.array([*whole.encode(docs[r.doc_id].text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), f"{DATA}/sf0.001").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
