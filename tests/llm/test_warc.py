"""Records against what they were made of, byte by byte."""

import base64
import hashlib
import random

import pytest

from ledgerlens.llm import warc

PAGES = "page_id bigint, url string, html string"


def pages_of(spark, rows, **extra):
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS digest", "'y' AS payload", "1 AS owner").repartition(3)


def archive(spark, tmp_path, rows):
    warc.write_archive(pages_of(spark, rows), f"{tmp_path}/a")
    return warc.read_archive(spark, f"{tmp_path}/a")


def brute_force(rows):
    owner = {}
    for page, _, html in rows:
        if page is not None:
            owner[html or ""] = max(owner.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw, mine = (html or "").encode(), owner.get(html or "")
        response = page == mine
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "response" if response else "revisit", None if response else mine))
    return sorted(map(str, out))


def test_revisits(spark, tmp_path):
    chance = random.Random(3)
    texts = ["", None, "é", "<p>a</p>", "x" * 500_000] + [f"<html>{i}ß" for i in range(20)]
    rows = [(i, f"http://h/{i}", chance.choice(texts)) for i in range(-20, 200)]
    rows += [(300, None, "only\r\nhere"), (None, "u", "é"), (None, "u", "no id"), (None, None, None), rows[7], rows[7]]
    got = warc.revisits(archive(spark, tmp_path, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_force(rows)


def test_exact_records(spark, tmp_path):
    rows = [(1, "http://a/\r\nWARC-Type: forged", "<p>é"), (2, None, ""), (3, "http://b", "<p>é")]
    got = {bytes(r.record).split(b"<urn:page:")[1][:1]: r for r in archive(spark, tmp_path, rows).collect()}
    for key, r in got.items():
        header, payload, record = bytes(r.header), bytes(r.payload), bytes(r.record)
        assert payload == (rows[int(key) - 1][2]).encode()
        size = int(header.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert header.endswith(b"\r\n\r\n") and header.count(b"\r\n\r\n") == 1 and header.startswith(b"WARC/1.1\r\n")
        assert record == header + (payload if b"WARC-Type: response\r\n" in header else b"") + b"\r\n\r\n"
        assert size == len(record) - len(header) - 4 and header.count(b"\r\nWARC-Type: ") == 1
    assert b"WARC-Refers-To: <urn:page:3>" in bytes(got[b"1"].header) and b"%0D%0AWARC-Type" in bytes(got[b"1"].header)


def test_payloads_are_stored_once_and_checked(spark, tmp_path):
    rows = [(i, "u", f"text {i % 7}") for i in range(100)]
    assert archive(spark, tmp_path, rows).count() == 100
    payloads = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert payloads.count() == 7
    payloads.selectExpr("digest", "CASE WHEN payload = CAST('text 3' AS BINARY) THEN CAST('forged' AS BINARY) ELSE payload END AS payload").write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/records").write.parquet(f"{tmp_path}/b/records")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()


def test_no_rows(spark, tmp_path):
    assert warc.revisits(archive(spark, tmp_path, [])).count() == 0
