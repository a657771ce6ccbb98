"""A content-addressed web archive.

Payload bytes are stored once per SHA-256 digest, which is verified when they are read; the exact header block of every
record is stored apart, with the digest it points to. Original records come back by joining the two. Everything runs in
the JVM; payloads cross the network once when they are stored and once when responses are put together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runvox.scale import checkpoint_root

#: Equal payloads of at least so many bytes are stored as one response and revisits.
LEAST_REVISIT = 1000
_END = "\r\n\r\n"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _safe(url: Column) -> Column:
    """A URL can't end a header line."""
    return F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Writes ``path``/payloads and ``path``/headers for rows (page_id, url, html).

    The payload is the html in UTF-8 (null: empty). Of equal payloads of ``least`` bytes or more, the largest page_id is
    the response and other pages revisit it (rows that repeat that page_id are responses too, as are all if every
    page_id is null); smaller ones are all responses. An empty table gives an empty archive. Other columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.select("page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"))
    stored = p.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("page_id").alias("winner"))
    stored.select("sha256", "payload", F.octet_length("payload").cast("long").alias("bytes"),
                  F.sha1("payload").alias("sha1"), "winner").write.parquet(f"{path}/payloads")
    index = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "bytes", "sha1", "winner")
    rows = p.select("page_id", "url", "sha256").join(index, "sha256")
    revisit = F.coalesce((F.col("bytes") >= least) & F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.lit(False))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        _field("WARC-Target-URI", _safe(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            _field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("winner").cast("string"), F.lit(">"))),
            _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string"), F.lit(_END)))
    rows.select("sha256", revisit.alias("revisit"), header.alias("header")).write.parquet(f"{path}/headers")


def _header(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?m)^{name}: (.*)$", 1)
    return F.when(found != "", found)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, header, record, payload_bytes): the exact records, put together from headers and payloads."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    whole = headers.where("NOT revisit").join(payloads.select("sha256", "payload", "bytes"), "sha256")
    part = headers.where("revisit").join(payloads.select("sha256", "bytes"), "sha256").withColumn("payload", F.lit(None).cast("binary"))
    return (whole.withColumn("payload", verified).unionByName(part)
            .select("sha256", "header", F.concat(F.col("header").cast("binary"), F.coalesce("payload", F.lit("").cast("binary")),
                                                 F.lit(_END).cast("binary")).alias("record"), F.col("bytes").alias("payload_bytes")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), parsed from the records. A response whose
    payload does not have the digest its header states ends the job."""
    # the header as it stands in the record, up to the first empty line
    r = records(spark, path).withColumn("header", F.concat(F.substring_index(F.col("record").cast("string"), _END, 1), F.lit(_END)))
    body = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    digest = F.substring_index(_header("WARC-Payload-Digest"), ":", -1)
    kind = _header("WARC-Type")
    good = (kind == "revisit") | ((F.sha1(body) == digest) & (F.octet_length(body) == _header("Content-Length").cast("long")))
    checked = F.when(good, digest).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("header"))).cast("string"))
    page = F.regexp_extract(_header("WARC-Record-ID"), r"^<urn:page:(-?\d+)>$", 1)
    refers = F.regexp_extract(_header("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1)
    return r.select(F.when(page != "", page.cast("long")).alias("page_id"), "payload_bytes", checked.alias("payload_digest"),
                    kind.alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes an archive into the shared folder and reads it back."""
    path = f"{checkpoint_root(pages.sparkSession)}/runvox/{uuid.uuid4().hex}-archive"
    write(pages, path)
    return read(pages.sparkSession, path)
