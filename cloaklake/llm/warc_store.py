"""Content-addressed WARC archive: payloads once, exact record headers apart, records rebuilt by joins.

An archive is a folder in the shared store with two Parquet tables. `payloads` (sha256, payload) holds the bytes of each
payload once, under the SHA-256 of those bytes. `headers` (page_id, sha256, header) holds, byte for byte, all of a WARC/1.1
record that stands before the payload: the WARC header and the HTTP header. A record is header + payload + CRLF CRLF, a
revisit record header + CRLF CRLF. Reading verifies each stored payload against its address before use.

Who is response: among records with equal payloads of at least `min_bytes`, the one with the largest page_id; the others
revisit it; smaller ones are all responses (their bytes still are stored once). Digests are worked out once and written without
the bytes. Only these narrow rows are grouped, with map-side maxima; the rows of a payload that very many pages share are
joined by a broadcast. The payload bytes move once, keyed by (sha256, page_id), for the page that stores them.

Defined results: a null html is an empty payload; a null page_id counts as smaller than all others; rows that repeat a
page_id with the same payload are alike (all response if that id is the largest); a null url has no WARC-Target-URI; line
breaks in a url are percent-encoded; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, written

CRLF = "\r\n"
#: Hot payloads that are joined by a broadcast at the most (a row of about 100 bytes each); beyond, all go through a shuffle.
HOT_KEYS = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(h: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string (20 bytes: no padding): four times 40 bits as eight digits."""
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _records(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    df = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    return df.withColumn("sha256", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def _header(date: str) -> Column:
    """The exact header bytes of a record, from page_id, url, refers_to, record_type, payload_bytes and digest."""
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record_id = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id("page_id")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", hot_rows: int = 100_000) -> str:
    """Write the archive of all rows to `path`; returns the path."""
    records = _records(pages, page_id, url, html)
    with scratch(pages.sparkSession):
        # digests once, without the bytes; all but the payloads comes from these rows
        narrow = written(records.withColumn("digest", base32_of_hex(F.sha1("payload"))).drop("payload"), "warc-digests")
        stores = narrow.groupBy("sha256").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        heads = hot_join(narrow, stores.filter("n > 1").select("sha256", "keeper"), "sha256", hot_rows)
        again = F.col("keeper").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
        heads = heads.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        heads = heads.withColumn("refers_to", F.when(again, F.col("keeper")))
        heads.select("page_id", "sha256", _header(date).alias("header")).write.parquet(f"{path}/headers")
        at = stores.select(F.col("sha256").alias("address"), "keeper")
        payloads = records.join(at, (F.col("sha256") == F.col("address")) & F.col("page_id").eqNullSafe(F.col("keeper")), "left_semi")
        if stores_twice(narrow):
            payloads = payloads.dropDuplicates(["sha256"])
        payloads.select("sha256", "payload").write.parquet(f"{path}/payloads")
    return path


def hot_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """left.join(right, key, "left") where right has a key once. Keys with more than hot_rows rows on the left, of which there are
    one for every hot_rows rows at the most, are joined by a broadcast, so that their rows stay where they are."""
    hot = left.groupBy(key).count().filter(F.col("count") > hot_rows).select(key)
    keys = [r[0] for r in hot.limit(HOT_KEYS + 1).collect()]
    if not keys or len(keys) > HOT_KEYS:
        return left.join(right, key, "left")
    own = F.col(key).isin(keys)
    return left.filter(own).join(F.broadcast(right.filter(own)), key, "left").unionByName(left.filter(~F.coalesce(own, F.lit(False))).join(right, key, "left"))


def stores_twice(records: DataFrame) -> bool:
    """Whether a (page_id, payload) pair repeats, so that one payload would be stored more than once."""
    return bool(records.groupBy("page_id", "sha256").count().filter("count > 1").take(1))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The parsed headers: page_id, sha256, header, record_type, refers_to, payload_digest."""
    df = spark.read.parquet(f"{path}/headers")
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    refers = F.regexp_extract(field("WARC-Refers-To"), r"^<urn:x-page:(-?[0-9]+)>$", 1)
    return df.withColumns({"record_type": field("WARC-Type"), "refers_to": F.when(refers != "", refers).cast("long"), "payload_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")})


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with what their bytes give on reading; intact is false where the bytes don't fit their address."""
    df = spark.read.parquet(f"{path}/payloads")
    return df.withColumns({"intact": F.sha2("payload", 256) == F.col("sha256"), "payload_bytes": F.octet_length("payload").cast("long"), "sha1": base32_of_hex(F.sha1("payload"))})


def page_records(spark: SparkSession, path: str, hot_rows: int = 100_000) -> DataFrame:
    """For each record, what reading it back gives; a record whose payload is missing or damaged has no bytes and no digest."""
    heads = headers(spark, path).drop("header")
    stored = verified_payloads(spark, path).filter("intact").select("sha256", "payload_bytes", F.col("sha1").alias("found"))
    out = hot_join(heads, stored, "sha256", hot_rows)
    good = F.col("found") == F.col("payload_digest")
    return out.select("page_id", F.when(good, F.col("payload_bytes")).alias("payload_bytes"), F.when(good, F.col("found")).alias("payload_digest"), "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record: the whole original records, header and payload joined on the digest."""
    heads = headers(spark, path)
    stored = verified_payloads(spark, path).filter("intact").select("sha256", "payload")
    out = heads.join(stored, "sha256", "left")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return out.select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def parse_record(record: bytes) -> dict:
    """The fields and the payload of one rebuilt record (for readers outside Spark, and tests)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(re.findall(rb"\r\n([A-Za-z-]+): ([^\r\n]*)", head))
    block = rest[: int(fields[b"Content-Length"])]
    return {k.decode(): v.decode() for k, v in fields.items()} | {"payload": block.partition(b"\r\n\r\n")[2], "tail": rest[len(block) :]}
