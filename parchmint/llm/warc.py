"""Operator 9: a content-addressed WARC archive: payload bytes once by digest, record headers beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_known, new_folder

CRLF = "\r\n"
#: Records that one copy of a payload is read for; a payload of more records is read in parts.
PART = 1000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32 (RFC 4648): 5 hex digits at a time are 4 digits of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def record_header(date: str) -> Column:
    """The bytes before the payload of a record, from page_id, url, type, refers_to, payload_bytes and digest. Control characters in a URL are written as %0A and the like, so they can't end a field."""
    url = F.coalesce(F.col("url"), F.lit(""))
    for n in (*range(32), 127):
        url = F.replace(url, F.lit(chr(n)), F.lit(f"%{n:02X}"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _id(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _field("WARC-Refers-To", _id(F.col("refers_to"))))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write `pages` (page_id, url, html; more columns are ignored) as path/payloads and path/headers.

    payloads: address (SHA-256), payload, first_page, n (its records); one row for each distinct payload. headers: a row for each page:
    page_id, address, part (of the payload's records, PART in each, about), header (the record's exact bytes up to the payload). A null html is an empty payload. Of pages
    with equal payloads of at least `min_bytes` bytes, those with the smallest page_id are responses and the others
    revisit it; null ids come after all others; rows that repeat the smallest id are responses as well. Smaller
    payloads are always responses. An empty table gives an empty archive.
    """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.withColumn("address", F.sha2("payload", 256))
    # equal digests are combined in each task first, so a frequent payload travels once from each
    kept = keyed.groupBy("address").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
    kept.write.parquet(f"{path}/payloads")
    written = pages.sparkSession.read.parquet(f"{path}/payloads")
    first = written.select("address", "first_page", F.col("n").alias("records"), "n")
    total = written.agg(F.sum("n")).first()[0] or 0
    facts = keyed.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    typed = join_known(facts, first, ["address"], total).withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_page")))
    part = F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.col("records") / PART)).cast("int")
    typed.select("page_id", "address", part.alias("part"), record_header(date).alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records again: page_id, header, payload (of the page, also for revisits), record (exact bytes: header, own payload, end mark).

    Every payload is checked against its address, and each header's digest against its payload; a difference stops the read.
    """
    # a payload goes to each part of its records, so a frequent one doesn't bring all of them to one task
    parts = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / PART) - 1).cast("int"))).alias("part")
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads = payloads.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its address")).cast("binary")).alias("payload"), "n").select("address", "payload", parts)
    records = spark.read.parquet(f"{path}/headers").join(payloads, ["address", "part"])
    own = F.when(F.decode("header", "UTF-8").contains(f"WARC-Type: revisit{CRLF}"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    return records.select("page_id", "header", "payload", F.concat("header", own, F.lit(CRLF * 2).cast("binary")).alias("record"))


def _read_field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the headers say, checked against the payload."""
    digest = F.regexp_replace(_read_field("WARC-Payload-Digest"), "^sha1:", "")
    read = records.select("header", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("found"), digest.alias("payload_digest"), _read_field("WARC-Type").alias("record_type"), _read_field("WARC-Record-ID").alias("field"), _read_field("WARC-Refers-To").alias("refers"))
    read = read.withColumn("payload_digest", F.when(F.col("found") == F.col("payload_digest"), F.col("found")).otherwise(F.raise_error(F.lit("a header's digest differs from its payload"))))
    number = lambda name: F.expr(f"try_cast(regexp_extract({name}, '^<urn:x-page:(.*)>$', 1) AS BIGINT)")
    return read.select(number("field").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return parse_records(read_archive(spark, path))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_page FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(d, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to
FROM f
"""
