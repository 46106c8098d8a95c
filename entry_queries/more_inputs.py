"""Further inputs derived from the given tables: odd texts, headers, landed files, orders as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from entry_queries.inputs import ledger_files, table

BATCH_TIME = datetime(2024, 6, 1, 12, 0, 0)
ORDER_COLUMNS = ["order_id", "o_orderstatus", "total", "order_date", "o_orderpriority"]


def _pick(number: Column, choices: list[Column]) -> Column:
    return F.get(F.array(*choices), F.pmod(number, F.lit(len(choices))).cast("int"))


def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of ``events`` in many notations: event_id, v."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    whole, part = F.floor(F.abs(cents) / 100).cast("string"), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")
    plain = F.concat(whole, F.lit("."), part)
    notations = ["{}", "${}", "PHP {}", "php{}", "({})", "($ {})", "$({})", "-${}", "€{}", "£ {}", "₱{}", "+{}", "00{}",
                 "1,{}", " {} ", " {} ", "{}e5", "-{}", "- {}", "(-{})", "{}.", "PHP", "", "n/a"]
    forms = []
    for notation in notations:
        before, _, after = notation.partition("{}")
        forms.append(F.concat(F.lit(before), plain, F.lit(after)) if "{}" in notation else F.lit(before))
    forms += [F.concat(F.lit("."), part), whole, F.concat(whole, F.lit(".")), F.lit("0.00"), F.lit("(0.00)"), F.lit("-0")]
    events = table(spark, sf_dir, "events")
    return events.select("event_id", _pick(F.col("event_id"), forms).alias("v"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of ``events`` in many notations: event_id, v."""
    ts = F.col("ts")

    def fmt(pattern: str) -> Column:
        return F.date_format(ts, pattern)

    iso_year = F.extract(F.lit("YEAROFWEEK"), ts).cast("string")
    iso_week = F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    iso_day = (F.weekday(ts) + 1).cast("string")
    forms = [
        fmt("yyyy-MM-dd"),
        fmt("yyyyMMdd"),
        fmt("yyyy-MM-dd'T'HH:mm:ss"),
        fmt("yyyy-MM-dd HH:mm"),
        F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")),
        F.concat(fmt("yyyyMMdd'T'HHmmss"), F.lit("+05:30")),
        F.concat(iso_year, F.lit("-W"), iso_week, F.lit("-"), iso_day),
        F.concat(iso_year, F.lit("W"), iso_week, iso_day),
        F.concat(iso_year, F.lit("-W"), iso_week),
        fmt("dd/MM/yyyy"),
        fmt("M/d/yyyy"),
        fmt("M/d/yyyy H:m:s"),
        fmt("yyyy-M-d H:m:s"),
        F.concat(fmt("yyyy-MM"), F.lit("-31")),
        F.concat(fmt("yyyy"), F.lit("-W60-1")),
        fmt("yyyy"),
        fmt("yyyy-MM"),
        fmt("HH:mm:ss"),
        F.concat(fmt("yyyy-MM-dd"), F.lit("T25:00")),
        F.lit("bad"),
        F.lit(""),
        F.lit("13/13/2024"),
        F.lit("00/20/2024"),
        F.concat(F.lit(" "), fmt("yyyy-MM-dd"), F.lit(" ")),
    ]
    return table(spark, sf_dir, "events").select("event_id", _pick(F.col("event_id"), forms).alias("v"))


# Names as they may head a column; most mean a concept.
HEADER_NAMES = ["Transaction-Date", "posted_date", " AMOUNT ", "net  amount", "Running_Balance", "reference number",
                "note", "withdrawals", "Deposit", "id", "Date", "Date", "", "amount", "Account Balance"]


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, one per row of ``customer``: file_id, header."""
    names = F.array(*[F.lit(n) for n in HEADER_NAMES])
    key = F.col("c_custkey")
    picks = [F.get(names, F.pmod(key * (i + 1) + F.floor(key / 7) * i, F.lit(len(HEADER_NAMES))).cast("int")) for i in range(5)]
    blank = F.array(F.lit(""), F.lit(" "))
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("file_id"), F.when(key % 50 == 0, blank).otherwise(F.array(*picks)).alias("header")
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table of texts, grouped by customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer"),
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").alias("ordered_at"),
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("order_id"),
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        "o_orderpriority",
    )


def long_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of orders with twenty decimal places, and of every third with a minus sign: file_id, row_no, value, and the value with 16 zeros less."""
    key = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    sign, price = F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("file_id"),
        (F.col("o_orderkey") + 2).alias("row_no"),
        F.concat(sign, price, key).alias("value"),
        F.concat(sign, F.replace(price, F.lit("."), F.lit("")), key, F.lit("0" * 14)).alias("large"),
    )


def encoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: some with a byte-order mark, broken bytes or nothing but white space."""
    key = F.col("doc_id")
    text = F.when(key % 13 == 0, F.lit(" \n\t ")).otherwise(F.col("text"))
    raw = F.encode(text, "UTF-8")
    content = (
        F.when(key % 5 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), raw))
        .when(key % 7 == 0, F.concat(raw, F.lit(b"\xff")))
        .otherwise(raw)
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        key.cast("string").alias("file_id"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


def source_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of ``documents``; src3 is inactive and src7 unknown."""
    sources = table(spark, sf_dir, "documents").select("source").distinct().filter("source <> 'src7'")
    return sources.select(
        F.col("source").alias("code"),
        F.concat(F.lit("System "), F.col("source")).alias("name"),
        F.lit("documents").alias("description"),
        F.lit("csv").alias("source_type"),
        (F.col("source") != "src3").alias("is_active"),
    )


def landed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files: path, original_filename, mime_type, source_system_code, discovered_at, content, lang."""
    key = F.col("doc_id")
    name = (
        F.when(key % 23 == 0, F.lit("folder/file.csv"))
        .when(key % 23 == 1, F.lit("ledger.txt"))
        .when(key % 23 == 2, F.lit("..\\escape.csv"))
        .when(key % 23 == 3, F.lit(".."))
        .when(key % 23 == 4, F.lit("  "))
        .when(key % 23 == 5, F.lit("€€.€"))
        .when(key % 23 == 6, F.concat(F.lit("Café "), F.left("text", F.lit(220)), F.lit(".csv")))
        .when(key % 23 == 7, F.concat(F.repeat(F.lit("long name "), 24), F.lit(".csv")))
        .otherwise(F.concat(F.lit("Doc "), key.cast("string"), F.lit(" ("), F.col("lang"), F.lit(").CSV")))
    )
    mime = (
        F.when(key % 29 == 0, F.lit("application/pdf"))
        .when(key % 29 == 1, F.lit(None).cast("string"))
        .when(key % 29 == 2, F.lit("Text/CSV; charset=utf-8"))
        .when(key % 29 == 3, F.lit(""))
        .otherwise(F.lit("text/csv"))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit("landing/"), key.cast("string")).alias("path"),
        name.alias("original_filename"),
        mime.alias("mime_type"),
        F.col("source").alias("source_system_code"),
        F.timestamp_seconds(F.lit(1_704_067_200) + key % 97).alias("discovered_at"),
        F.encode("text", "UTF-8").alias("content"),
    )


def _writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    # Made inside a function so that it reaches the workers by value, without this package installed there.
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row but the first of a task becomes a file; a task that is run again writes the same files."""
        import os

        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        os.makedirs(path, exist_ok=True)
        for batch in batches:
            for row, value in enumerate(batch.column(0)):
                if number:
                    with open(f"{path}/part-{part:05d}-{number}.txt", "wb") as file:
                        file.write((value.as_py() or "").encode() + b"\n")
                else:
                    yield batch.slice(row, 1)
                number += 1

    return written


def write_files(files: DataFrame, path: str) -> None:
    """One real file per row of text ``content``; the writer ends each file with the last newline.

    Tasks move their own files to the folder: there are as many as rows, and the driver would move them one after the other. In a
    folder of the file system they also write them, but for one: Spark's writer starts three processes a file there, to set its rights.
    """
    texts = files.select(F.regexp_replace(F.decode("content", "UTF-8"), r"\n\z", "").alias("value"))
    scheme, _, rest = path.rpartition(":")
    if scheme in ("", "file"):
        texts = texts.mapInArrow(_writer(f"/{rest.lstrip('/')}"), "value string")
    texts.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)


def corpus_folder(spark: SparkSession, sf_dir: str, keep: Column | None = None) -> str:
    """The ledger files written as real files to a new folder."""
    from ledgerlens.durable import scratch_path

    path = scratch_path(spark, "corpus")
    files = ledger_files(spark, sf_dir)
    write_files(files if keep is None else files.filter(keep), path)
    return path
