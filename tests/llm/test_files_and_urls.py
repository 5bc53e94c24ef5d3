import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from cloaklake.llm import token_files, url_filter, warc_store
from cloaklake.llm.shared import fresh_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "a", "  two  blanks ", "line\n\n  break \t tab", "naïve Straße 𝒳 emoji 😀!", "it's we'll   don't", "x" * 5000, "a b " * 3000, " nbsp  em", "end \n", "\x1c \x1d y", "tie", "tie"]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "no id", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, tokens int")


HARD = ["a,b—,é,×, é.\nB.\n\nC it's a're?", "a\tb,\tc ,d", "\n", "\na\n", " \na ", "don't’s", "<|endoftext|> a <|endoftext|>x", "à la é è\u0085 f", "\u2003em\u3000,b\u00a0c"]


def test_pieces_encode_as_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from cloaklake.llm.wordkernel import text_bytes

    whole, own = Tokenizer.from_file(TOKENIZER), token_files.PieceEncoder(TOKENIZER, most=50)
    texts = [t or "" for t in TEXTS] + HARD + ["many words " + " ".join(f"w{i}" for i in range(200))]
    data, off = text_bytes(pa.array(texts))
    for i, j in [(0, 5), (5, len(texts)), (0, len(texts))]:
        ids, n = own(data, off, i, j, 0)
        for got, e in zip(np.split(ids, np.cumsum(n)[:-1]), whole.encode_batch(texts[i:j], add_special_tokens=False), strict=True):
            assert got.tolist() == [*e.ids, 0]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    df = documents(spark)
    folder = fresh_path(spark, "tokens-test")
    shards = token_files.write_tokens(df, folder, TOKENIZER, seq_len=16, rows=3)
    got = {r.doc_id: r for r in token_files.read_tokens(shards, folder).collect()}
    whole, start = Tokenizer.from_file(TOKENIZER), 0
    for i, t in [(None, "no id"), *enumerate(TEXTS)]:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = shards.first().shard
    table = token_files.read_sequences(f"{folder}/tokens-{one:06d}.arrow")
    assert table.schema.field("input_ids").type.list_size == 16
    real = sum(sum(x) for x in table.column("attention_mask").to_pylist())
    assert real == shards.first().tokens


def test_no_documents(spark):
    assert token_files.token_corpus(documents(spark).limit(0), TOKENIZER).count() == 0


def test_urls(spark):
    rows = ["http://A.Example.NET/en/x?q", "http://example.net/de/", "http://notexample.com/de/", "http://x.example.com/de/", "https://org/fr/a#b", "http://org", None, "no scheme", "://net/", "http://net", "http://a.b.net/", ""]
    rows = [(i, u, "clash") for i, u in enumerate([*rows, rows[0]])]
    got = [tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string")).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("example.net", "/de/", "net/", "block"),
        ("notexample.com", "/de/", None, "allow"),
        ("x.example.com", "/de/", "example.com/de/", "block"),
        ("org", "/fr/a", "org/fr/", "allow"),
        ("org", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("net", "/", "net/", "block"),
        ("net", "", None, "allow"),
        ("a.b.net", "/", "net/", "block"),
        ("", "", None, "allow"),
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
    ]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_urls_joined_either_way(spark, limit):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert url_filter.judge_urls(df, broadcast_rules=limit).first().rule == "net/"


def test_urls_empty_and_longest_rule(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(df).count() == 0
    df = spark.createDataFrame([("http://b.a.com/x/y",)], "url string")
    rules = [("block", "com", ""), ("allow", "a.com", "/x"), ("block", "a.com", "/x/"), ("allow", "b.a.com", "/z")]
    assert url_filter.judge_urls(df, rules).first()["rule"] == "a.com/x/"
    assert url_filter.judge_urls(df, []).first()["verdict"] == "allow"


PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "é" * 4000), (5, "http://e/", "é" * 4000), (None, "http://f/", "same"), (None, None, "lone")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, sha256 string")
    path = warc_store.write_archive(df, fresh_path(spark, "warc-test"))
    got = sorted(map(tuple, warc_store.page_records(spark, path).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        keeper = max((p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        again = keeper is not None and i != keeper
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", keeper if again else None))
    assert got == sorted(want, key=str)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("sha256").distinct().count() == 4
    for r in warc_store.reconstruct(spark, path).collect():
        fields = warc_store.parse_record(bytes(r.record))
        assert fields["tail"] == b"\r\n\r\n" and "X" not in fields
        if fields["WARC-Type"] == "response":
            raw = fields["payload"]
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_warc_small_payloads_and_damage(spark):
    df = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string")
    path = warc_store.write_archive(df, fresh_path(spark, "warc-test"), min_bytes=5)
    assert {r.record_type for r in warc_store.page_records(spark, path).collect()} == {"response"}
    assert spark.read.parquet(f"{path}/payloads").count() == 1
    damaged = spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "cast('other' as binary) payload").toPandas()
    spark.createDataFrame(damaged, "sha256 string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    assert {r.payload_digest for r in warc_store.page_records(spark, path).collect()} == {None}


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc_store.write_archive(df, fresh_path(spark, "warc-test"))
    assert warc_store.page_records(spark, path).count() == 0


def test_hot_payloads_are_joined_by_broadcast(spark):
    rows = [(i, f"http://a/{i}", "hot" if i % 3 else f"cold {i % 7}") for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for hot_rows in (10, 100_000):
        path = warc_store.write_archive(df, fresh_path(spark, "hot"), hot_rows=hot_rows)
        found.append(sorted(tuple(r) for r in warc_store.page_records(spark, path, hot_rows).collect()))
    assert found[0] == found[1] and len(found[0]) == 90
    assert sum(r[3] == "response" for r in found[0]) == 8


def test_shards_grow_with_the_text_and_split_equal_ids(spark):
    rows = [(None if i % 2 else 5, f"text {i} " * 20) for i in range(400)] + [(7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = fresh_path(spark, "small-shards")
    shards = token_files.write_tokens(df, folder, tokenizer, shard_bytes=4000)
    assert shards.count() >= 10 and max(r.docs for r in shards.collect()) < 100
    got = token_files.read_tokens(shards, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 200 + [5] * 200 + [7, 8]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
