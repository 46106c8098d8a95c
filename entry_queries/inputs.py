"""Inputs of the registered queries, derived by Spark from the given tables.

``ledger``: one bank-like ledger per user of ``events``, with flaws of every kind mixed in. The order of a
ledger is (ts, event_id); amounts are whole cents, so every text is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.config import RECORD_ROWS
from ledgerlens.durable import materialize
from ledgerlens.operators.ordered import number_rows, running_sum
from ledgerlens.sources.tables import records_from_table

LEDGER_COLUMNS = ["transaction_id", "posted_date", "amount", "balance", "description", "note", "units", "settled", "booked_at", "memo"]
SIDES_COLUMNS = ["transaction_id", "posted_date", "debit", "credit", "balance", "description"]
# Longest file made from a ledger; a longer ledger becomes several files.
FILE_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents_text(cents: Column) -> Column:
    size = F.abs(cents)
    return F.concat(
        F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0")
    )


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    cents = F.round(F.col("value") * 100).cast("bigint")
    moved = events.withColumn("mv", F.when(F.col("event_type").isin("purchase", "error"), -cents).otherwise(cents))
    return number_rows(moved.drop("value"), ["user_id"], ["ts", "event_id"], first=2)


_staged: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An input table, derived once per session and folder and written to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = materialize(build(), name, RECORD_ROWS)
    return _staged[key]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "ledger", lambda: _ledger(spark, sf_dir))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = running_sum(numbered_events(spark, sf_dir), ["user_id"], "row_no", F.col("mv"), "bc")
    event, ts, mv = F.col("event_id"), F.col("ts"), F.col("mv")

    def every(n: int) -> Column:
        return event % n == 0

    a = _cents_text(mv)
    b = F.concat(F.when(F.col("bc") < 0, "-").otherwise(""), _cents_text(F.col("bc")))
    return rows.select(
        F.col("user_id").cast("string").alias("file_id"),
        F.col("row_no").cast("bigint").alias("row_no"),
        F.when(every(101), "").when(every(53), "T0").otherwise(F.concat(F.lit("T"), event.cast("string"))).alias("transaction_id"),
        F.when(every(97), "bad")
        .when(every(89), "01/02/2024")
        .when(every(5) & (F.dayofmonth(ts) > 12), F.date_format(ts, "dd/MM/yyyy"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
        .alias("posted_date"),
        F.when((F.col("user_id") % 3 == 0) & every(103), "n/a")
        .when((mv < 0) & every(2), F.concat(F.lit("("), a, F.lit(")")))
        .when(mv < 0, F.concat(F.lit("-"), a))
        .when(every(7), F.concat(F.lit("$"), a))
        .when(every(11), F.concat(F.lit("PHP "), a))
        .otherwise(a)
        .alias("amount"),
        F.when(every(199), F.concat(b, F.lit("9"))).when(every(211), "0.00").otherwise(b).alias("balance"),
        F.col("event_type").alias("description"),
        F.when(every(3), "x").otherwise("").alias("note"),
        F.when(every(13), "many").otherwise((event % 50).cast("string")).alias("units"),
        F.when(every(2), "Yes").otherwise("no").alias("settled"),
        F.when(every(17), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(every(19), F.date_format(ts, "M/d/yyyy H:m:s"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .alias("booked_at"),
        F.lit("").alias("memo"),
    )


def ledger_records(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return records_from_table(ledger(spark, sf_dir), "file_id", columns or LEDGER_COLUMNS, row_no="row_no")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledgers with debit and credit columns instead of amounts."""
    amount = F.col("amount")
    out = amount.startswith("(") | amount.startswith("-")
    plain = F.regexp_replace(amount, r"^PHP |[$()-]", "")
    return ledger(spark, sf_dir).withColumns(
        {"debit": F.when(out, plain).otherwise(""), "credit": F.when(out, "").otherwise(amount)}
    )


def sides_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_from_table(sides(spark, sf_dir), "file_id", SIDES_COLUMNS, row_no="row_no")


# --- files ------------------------------------------------------------------------------------------------

FILE_COLUMNS = ["transaction_id", "posted_date", "amount", "balance", "description"]
DELIMITERS = (",", ";", "\t", "|")


def ledger_lines(spark: SparkSession, sf_dir: str, flawed: bool) -> DataFrame:
    """Lines of the files: file_key, delimiter, row_no, sub, event, fields. ``flawed`` adds odd lines.

    A file holds at most FILE_ROWS rows of one ledger, whatever the length of the ledger. Flawed files are
    all comma-separated: no delimiter can be told from ragged lines, and the comma is the default.
    """
    rows = ledger(spark, sf_dir)
    part = F.floor((F.col("row_no") - 2) / FILE_ROWS).cast("bigint")
    key = F.lit(0) if flawed else F.pmod(F.col("file_id").cast("bigint"), F.lit(4)).cast("int")
    fields = F.array(*[F.col(c) for c in FILE_COLUMNS])
    lines = rows.select(
        F.concat_ws("-", "file_id", part.cast("string")).alias("file_key"),
        F.get(F.array(*[F.lit(d) for d in DELIMITERS]), key).alias("delimiter"),
        "row_no",
        fields.alias("fields"),
    )
    if not flawed:
        return lines.withColumn("sub", F.lit(1))
    n = F.col("row_no")
    shaped = (
        F.when(n % 11 == 0, F.concat("fields", F.array(F.lit("extra"), F.lit("extra"))))
        .when(n % 13 == 0, F.slice("fields", 1, 3))
        .otherwise(F.col("fields"))
    )
    padded = F.transform(shaped, lambda f: F.concat(F.lit(" "), f, F.lit(" ")))
    blank = F.array(F.lit(""), F.lit("  "))
    variants = F.array_compact(
        F.array(
            F.when(n % 7 == 0, F.struct(F.lit(0).alias("sub"), blank.alias("fields"))),
            F.struct(F.lit(1).alias("sub"), F.when(n % 5 == 0, padded).otherwise(shaped).alias("fields")),
            F.when(n % 17 == 0, F.struct(F.lit(2).alias("sub"), shaped.alias("fields"))),
            F.when(n % 19 == 0, F.struct(F.lit(3).alias("sub"), F.array().cast("array<string>").alias("fields"))),
        )
    )
    return lines.select("file_key", "delimiter", "row_no", F.explode(variants).alias("v")).select(
        "file_key", "delimiter", "row_no", "v.sub", "v.fields"
    )


def ledger_files(spark: SparkSession, sf_dir: str, flawed: bool = False) -> DataFrame:
    """Files as the binary file source would list them: file_key, path, modificationTime, length, content, file_id."""
    lines = ledger_lines(spark, sf_dir, flawed)
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "sub", "line"))), lambda x: x["line"]), "\n"
    )
    files = (
        lines.withColumn("line", F.expr("concat_ws(delimiter, fields)"))
        .groupBy("file_key", "delimiter")
        .agg(text.alias("body"))
        .withColumn("head", F.expr(f"concat_ws(delimiter, array({', '.join(repr(c) for c in FILE_COLUMNS)}))"))
        .withColumn("content", F.encode(F.concat("head", F.lit("\n"), "body", F.lit("\n")), "UTF-8"))
    )
    return files.select(
        "file_key",
        F.concat(F.lit("ledger/"), "file_key", F.lit(".csv")).alias("path"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.octet_length("content").cast("bigint").alias("length"),
        "content",
        F.sha2("content", 256).alias("file_id"),
    )
