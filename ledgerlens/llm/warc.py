"""A content-addressed archive of WARC records, with DataFrame functions only.

``payloads`` holds every distinct payload once, under its SHA-256; ``records`` holds the exact header block of every
record and the digest of its payload. A join on the digest gives the records back; the bytes are checked
against their digest when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DATE = "2024-01-01T00:00:00Z"
_LINE = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 in upper-case base 32: five hexadecimal digits at a time are four characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(date: str) -> Column:
    """The header block of a page's record, up to and with the empty line. Line ends in a URL are percent-encoded."""
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    identity = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_LINE))
    revisit = F.col("refers_to").isNotNull()
    lines = [
        F.lit(f"WARC/1.1{_LINE}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise("response")),
        line("WARC-Record-ID", identity(F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.coalesce(line("WARC-Refers-To", identity(F.col("refers_to"))), F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(_LINE),
    ]
    return F.concat(*lines).cast("binary")


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Stores a record for every row (page_id, url, html) of ``pages``; other columns are left out.

    The payload is the html in UTF-8, null as empty. Of the records of equal payloads the one with the largest
    page_id is the response, and the others revisit it; an id that repeats there is a response each time. Records
    without an id revisit too, and are responses where no record of that payload has an id.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # equal payloads meet on the map side first
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads.write.parquet(f"{path}/payloads")

    records = rows.select("page_id", "url", "digest", F.length("payload").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    owners = records.groupBy("digest").agg(F.max("page_id").alias("owner"))
    records = records.join(owners, "digest")
    refers_to = F.when(F.col("page_id").eqNullSafe(F.col("owner")), F.lit(None)).otherwise(F.col("owner"))
    records = records.withColumn("refers_to", refers_to.cast("bigint"))
    records.select("digest", _header(date).alias("header")).write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: header (binary), payload (binary, of a revisit too), record (the exact bytes of the WARC record).

    A payload whose bytes don't give its digest is an error.
    """
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
    broken = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary")
    payloads = payloads.select("digest", F.coalesce(checked, broken).alias("payload"))
    records = spark.read.schema("digest string, header binary").parquet(f"{path}/records")
    block = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header"), block, F.lit((_LINE * 2).encode()))
    return records.join(payloads, "digest").select("header", "payload", record.alias("record"))


def field(name: str) -> Column:
    """A field of the column ``header``; null if there is none."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def revisits(records: DataFrame) -> DataFrame:
    """One row (page_id, payload_bytes, payload_digest, record_type, refers_to) per record that was read back."""
    number = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    return records.select(
        number("WARC-Record-ID").alias("page_id"),
        F.length("payload").cast("bigint").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
    )
