"""The registered queries of the operators in this folder, with production parameters, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, conversation_repair, decontaminate, language_id, licence_scan, lm_score, ngram_join, pfair_mix, source_audit, token_files, toxicity, url_filter, warc_store
from .shared import fresh_path, table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_licences(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).drop("url")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc_store.write_archive(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc_store.page_records(spark, path)


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return pfair_mix.mix(docs)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.nearest(table(spark, sf_dir, "embeddings"))


def op10_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over eight learned parts, however small the table, held against the search of all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    exact = ann_search.nearest(vectors, parts=1).select("query_id", "vec_id")
    found = ann_search.nearest(vectors, parts=8).select("query_id", "vec_id").withColumn("hit", F.lit(1))
    share = F.count("hit") >= 0.9 * F.count("*")
    return exact.join(found, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("nearest"), share.alias("recall_is_90_percent"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": op1_licence_scan,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_lm_score": op4_lm_score,
    "op5_url_filter": op5_url_filter,
    "op6_warc": op6_warc,
    "op7_pfair_mix": op7_pfair_mix,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_files": op9_token_files,
    "op10_ann_search": op10_ann_search,
    "op10_recall": op10_recall,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_toxicity": op12_toxicity,
    "op13_source_audit": op13_source_audit,
}



def _repair_sql() -> str:
    """Repair by recursion over messages: each state's cheapest edits with their letters and what they leave."""
    put = lambda x, cost, letter, said: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'e': {x}.e || '{letter}', 'r': {said}}} END"
    insert = lambda x, who: put(x, 3, "I", f"list_append({x}.r, '{who}:')")
    delete = lambda x: put(x, 4, "D", f"{x}.r")
    keep = lambda x, initial: f"CASE WHEN fault IN ('', 'T') AND role[1] = '{initial}' THEN {put(x, 'extra', 'K', f"list_append({x}.r, role || ':' || text)")} END"
    rerole = lambda x, who: f"CASE WHEN fault IN ('', 'T') THEN {put(x, '3 + extra', 'R', f"list_append({x}.r, '{who}:' || text)")} END"
    least = lambda *xs: f"list_min(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))"
    inserts = lambda table: f"""SELECT * REPLACE ({least("u", insert("a", "user"))} AS u) FROM (SELECT * REPLACE ({least("a", insert("u", "assistant"))} AS a)
      FROM (SELECT * REPLACE ({least("u", insert("z", "user"), insert("s", "user"), insert("a", "user"))} AS u) FROM {table}))"""  # noqa: E731
    state = "STRUCT(c BIGINT, e VARCHAR, r VARCHAR[])"
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n::BIGINT)) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
  FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen FROM d),
m AS (SELECT conv_id, turn, role, text, i, CASE WHEN seen = '' THEN 'B' WHEN nth > 1 THEN 'D' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'T' ELSE '' END AS fault,
  lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
f AS (SELECT *, CASE WHEN fault = 'T' THEN 3 ELSE 0 END AS extra FROM m),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'e': '', 'r': []}}::{state}, NULL::{state}, NULL::{state}, NULL::{state} FROM ids
  UNION ALL
  SELECT conv_id, i, {delete("z")}, {least(delete("s"), keep("z", "s"))},
    {least(delete("u"), *[f(x, w) for x in "zsa" for f, w in ((keep, "u"), (rerole, "user"))])},
    {least(delete("a"), keep("u", "a"), rerole("u", "assistant"))}
  FROM ({inserts("(SELECT dp.conv_id, f.i, z, s, u, a, role, text, fault, extra FROM dp JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i + 1)")})),
ended AS (SELECT conv_id, {least("z", "a")} AS best FROM ({inserts("(SELECT * FROM dp QUALIFY i = max(i) OVER (PARTITION BY conv_id))")})),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'B') AS blank, count_if(fault = 'D') AS duplicate, count_if(fault = 'T') AS truncated,
  count_if(i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.e AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""


ORACLE_SQL: dict[str, str] = {
    "op10_recall": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
w AS (SELECT u.* FROM u JOIN (SELECT len(v) AS n FROM u GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1) m ON len(u.v) = m.n),
q AS (SELECT vec_id, (SELECT least(20, count(*) - 1) FROM w) AS own FROM w WHERE vec_id % 20 = 0)
SELECT count(DISTINCT vec_id) AS queries, CAST(sum(own) AS BIGINT) AS nearest, true AS recall_is_90_percent FROM q
""",
    "op5_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rhost, rpath, rverdict)),
p AS (SELECT DISTINCT host, path FROM h),
m AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT h.page_id, h.host, h.path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.host = m.host AND h.path = m.path
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(h, 1 + 10 * CAST(floor(i / 8) AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
""",
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM n JOIN s sa ON a = sa.doc_id JOIN s sb ON b = sb.doc_id WHERE 100 * n >= 75 * (len(sa.s) + len(sb.s) - n)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN both_ways b ON r.other = b.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id FROM s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.s)
""",
    # one part holds all of the small tables, where the search is exact; vec_ids are unique there
    "op10_ann_search": r"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
n AS (SELECT len(v) AS n FROM u GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1),
w AS (SELECT u.* FROM u JOIN n ON len(u.v) = n.n),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
    "op11_conversation_repair": _repair_sql(),
    "op13_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
x AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
c AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN k ON x.lang = k.lang AND x.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total,
  (SELECT count(*) FROM k WHERE k.lang = g.lang) AS v, coalesce((SELECT sum(n) FROM k WHERE k.lang = g.lang), 0) AS l_total FROM g),
s AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (gn.total + 5 * gn.v) AS p,
  1 + (1000000000 * (k.n + 5)) // (gn.l_total + 5 * gn.v) AS q
  FROM gn JOIN k ON gn.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.term = k.term AND c.source = gn.source),
f AS (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS v FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.v, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
""",
}
