"""Ledgers: control totals and running balances.

A ledger row has the texts of the four money concepts, taken from the first column of each concept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.config import ProfilingConfig
from ledgerlens.durable import materialize
from ledgerlens.functions import money
from ledgerlens.functions.limbs import limbs_of, total
from ledgerlens.functions.text import decimal_text
from ledgerlens.operators.concepts import MONEY, concept_position
from ledgerlens.operators.exact import long_balances, long_totals
from ledgerlens.operators.ordered import block_of

SUM_TYPE = "decimal(37,10)"
RESULT_TYPE = "decimal(24,6)"


def ledger_view(records: DataFrame) -> DataFrame:
    """file_id, row_no, balance_name and, per money concept, its text: NULL where the file has no such column."""
    at = {c: concept_position(F.col("concepts"), c) for c in MONEY}
    return records.select(
        "file_id",
        "row_no",
        F.get("names", at["balance"]).alias("balance_name"),
        *[F.get("fields", at[c]).alias(c) for c in MONEY],
    )


def movements(ledger: DataFrame) -> DataFrame:
    """Adds parsed ``*_number`` structs, the ``movement`` of a row and its ``movement_text`` scale.

    Amounts are movements if the file has an amount column, whether they parse or not; otherwise credit less
    debit, a blank side counting as zero. NULL marks a row without a usable movement. A ledger that has its movements stays as it is.
    """
    if "movement" in ledger.columns:
        return ledger
    numbers = ledger.withColumns({f"{c}_number": money.parse(c) for c in MONEY})

    def side(c: str) -> Column:
        blank = F.coalesce(F.col(c), F.lit("")) == ""
        return F.when(blank, F.lit(0).cast(money.VALUE_TYPE)).otherwise(F.col(f"{c}_number.value"))

    def scale(c: str) -> Column:
        return F.coalesce(money.scale_of(F.col(f"{c}_number.text")), F.lit(0))

    has_sides = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    return numbers.withColumns(
        {
            "movement": F.when(F.col("amount").isNotNull(), F.col("amount_number.value"))
            .when(has_sides, side("credit") - side("debit"))
            .try_cast(money.VALUE_TYPE),
            "movement_scale": F.when(F.col("amount").isNotNull(), scale("amount")).otherwise(
                F.greatest(scale("debit"), scale("credit"))
            ),
        }
    )


def control_totals(ledger: DataFrame) -> DataFrame:
    """file_id, monetary_total, debit_total, credit_total; NULL where nothing parses, or the total does not fit.

    Files with numbers that no DECIMAL holds take their totals from limbs. ``ledger`` may be parsed already (``movements``).
    """
    known = "movement" in ledger.columns
    sums = {"monetary_total": "amount", "debit_total": "debit", "credit_total": "credit"}
    parsed = ledger.select("file_id", *[(F.col(f"{c}_number") if known else money.parse(c)).alias(c) for c in sums.values()])
    too_large = [F.coalesce(F.col(f"{c}.valid") & F.col(f"{c}.value").isNull(), F.lit(False)) for c in sums.values()]
    totals = [F.sum(f"{c}.value").try_cast(RESULT_TYPE).alias(name) for name, c in sums.items()]
    held = parsed.groupBy("file_id").agg(*totals, F.max(too_large[0] | too_large[1] | too_large[2]).alias("long"))
    held = materialize(held, "totals")
    long_files = held.where("long").select("file_id")
    held = held.where("NOT long").drop("long")
    return held if long_files.isEmpty() else held.unionByName(long_totals(parsed, long_files, sums))


def _block_totals(rows: DataFrame) -> DataFrame:
    """One row per (file, block): what a later block must know about the earlier ones."""
    balance, movement = F.col("balance_number.value"), F.col("movement")
    too_long = F.lit(False)
    for c in MONEY:
        too_long = too_long | F.coalesce(F.col(f"{c}_number.valid") & F.col(f"{c}_number.value").isNull(), F.lit(False))
    first = F.when(F.col("row_no") == 2, balance.cast(SUM_TYPE) - movement)
    first_scale = F.when(F.col("row_no") == 2, money.scale_of(F.col("balance_number.text")))
    return rows.groupBy("file_id", "block").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(balance).alias("balances"),
        F.count(movement).alias("movements"),
        F.sum(movement).cast(SUM_TYPE).alias("moved"),
        F.max("movement_scale").alias("scale"),
        F.max(first).cast(SUM_TYPE).alias("opening"),
        F.max(first_scale).alias("opening_scale"),
        F.max(too_long).alias("long"),
    )


def followed(ledger: DataFrame, config: ProfilingConfig = ProfilingConfig(), block_rows: int | None = None) -> DataFrame:
    """All rows with the balance expected from the opening balance and all movements so far.

    Rows of ledgers that are not verifiable have no expected balance. ``opening``, ``closing`` and ``calculated`` are what the row says of its
    ledger's balances, as they are stored. Ledgers with numbers that no DECIMAL holds are followed by limbs.
    """
    rows = movements(ledger).withColumn("block", block_of("row_no", block_rows))
    file, earlier = Window.partitionBy("file_id"), Window.partitionBy("file_id").orderBy("block")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    complete = (F.sum("movements").over(file) == F.sum("rows").over(file)) & (
        F.sum("balances").over(file) == F.sum("rows").over(file)
    )
    totals = materialize(_block_totals(rows), "block-totals")
    # Windows over whole ledgers see one row per block only.
    starts = totals.select(
        "file_id",
        "block",
        complete.alias("verifiable"),
        F.max("opening").over(file).alias("opening"),
        F.coalesce(F.sum("moved").over(before), F.lit(0)).cast(SUM_TYPE).alias("moved_before"),
        F.greatest(F.max("opening_scale").over(file), F.max("scale").over(before)).alias("scale_before"),
    )
    inside = Window.partitionBy("file_id", "block").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    expected = (F.col("opening") + F.col("moved_before")).cast(SUM_TYPE) + F.col("moved")
    table = (
        rows.select(
            "file_id",
            "block",
            "row_no",
            "balance_name",
            F.col("balance_number.value").alias("reported"),
            F.col("balance_number.text").alias("reported_text"),
            F.sum("movement").over(inside).cast(SUM_TYPE).alias("moved"),
            F.max("movement_scale").over(inside).alias("scale"),
        )
        .join(starts, ["file_id", "block"])
        .select(
            "file_id",
            "row_no",
            "balance_name",
            "reported",
            "reported_text",
            "verifiable",
            "opening",
            F.greatest("scale", "scale_before").alias("scale"),
            F.when(F.col("verifiable"), expected).cast(SUM_TYPE).alias("expected"),
        )
        .withColumn("matches", F.abs(F.col("expected") - F.col("reported")) <= F.lit(config.balance_tolerance))
        .withColumns(
            {
                "opening": F.col("opening").try_cast(RESULT_TYPE),
                "closing": F.col("reported").try_cast(RESULT_TYPE),
                "calculated": F.col("expected").try_cast(RESULT_TYPE),
                "expected_text": decimal_text(F.col("expected"), F.col("scale")),
                "negative": F.col("reported") < 0,
            }
        )
    )
    long_files = totals.groupBy("file_id").agg(F.max("long").alias("long")).where("long").select("file_id")
    if long_files.isEmpty():
        return table
    same = table.join(long_files, "file_id", "left_anti")
    return same.unionByName(_followed_by_limbs(rows, table, long_files, config).select(same.columns))


def _followed_by_limbs(rows: DataFrame, table: DataFrame, long_files: DataFrame, config: ProfilingConfig) -> DataFrame:
    """The rows of ``long_files`` in ``table``, with everything that hangs on values worked out anew."""
    given = F.col("amount").isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    sides = [F.coalesce(F.col(f"{c}_number.valid"), F.lit(False)) | blank(c) for c in ("credit", "debit")]
    moved = F.when(given, F.col("amount_number.valid")).otherwise((F.col("debit").isNotNull() | F.col("credit").isNotNull()) & sides[0] & sides[1])
    facts = rows.join(long_files, "file_id", "left_semi").select(
        "file_id",
        "row_no",
        F.when(given, F.col("amount_number.text")).otherwise(F.col("credit_number.text")).alias("plus"),
        F.when(~given, F.col("debit_number.text")).alias("minus"),
        (F.coalesce(moved, F.lit(False)) & F.coalesce(F.col("balance_number.valid"), F.lit(False))).alias("complete"),
    )
    held = table.select("file_id", "row_no", "balance_name", "reported", "reported_text", "scale").join(facts, ["file_id", "row_no"])
    held = materialize(held, "long-rows")
    result = long_balances(held, str(config.balance_tolerance)).withColumnRenamed("expected", "calculated")
    closing = total(F.transform(limbs_of(F.col("reported_text")), lambda p: F.struct(p["i"].alias("i"), p["v"].cast("decimal(38,0)").alias("v"))))
    return held.join(result, ["file_id", "row_no"]).withColumns(
        {
            "closing": F.when(F.col("reported_text").isNotNull(), closing),
            "negative": F.col("reported_text").startswith("-") & F.col("reported_text").rlike("[1-9]"),
            "expected": F.lit(None).cast(SUM_TYPE),
        }
    )




def running_balance(
    ledger: DataFrame, config: ProfilingConfig = ProfilingConfig(), block_rows: int | None = None
) -> DataFrame:
    """Rows of verifiable ledgers: file_id, row_no, balance_name, reported, expected, reported_text, scale, expected_text, negative, matches.

    expected = opening balance + all movements so far; it never restarts from a reported balance. ``scale``
    is the number of decimal places it is written with. Where numbers are too long for a DECIMAL, only the texts hold them.
    """
    return balances_of(followed(ledger, config, block_rows))


def balances_of(rows: DataFrame) -> DataFrame:
    """The same from rows that have been ``followed``."""
    return rows.filter("verifiable").drop("verifiable", "opening", "closing", "calculated")


def balance_summary(
    ledger: DataFrame, config: ProfilingConfig = ProfilingConfig(), block_rows: int | None = None
) -> DataFrame:
    """One row per file with a parseable balance: opening, closing and calculated closing balance, validity.

    ``verifiable`` is false when movements or balances are incomplete; validity and opening are NULL then.
    The last row with a balance decides on the closing balance, every row on the validity. A balance that the stored type cannot hold is NULL.
    """
    return summary_of(followed(ledger, config, block_rows))


def summary_of(rows: DataFrame) -> DataFrame:
    """The same from rows that have been ``followed``."""
    last = F.when(F.col("reported_text").isNotNull(), F.col("row_no"))
    totals = (
        rows.groupBy("file_id")
        .agg(
            F.max("verifiable").alias("verifiable"),
            F.max("opening").alias("opening"),
            F.max(last).alias("last"),
            F.max_by("closing", last).alias("closing"),
            F.max_by("calculated", "row_no").alias("calculated"),
            F.min("matches").alias("all_match"),
        )
        .filter(F.col("last").isNotNull())
    )
    verified = F.col("verifiable")
    return totals.select(
        "file_id",
        "verifiable",
        F.when(verified, F.col("opening")).alias("opening_balance"),
        F.col("closing").alias("closing_balance"),
        F.col("calculated").alias("calculated_closing_balance"),
        F.when(verified, F.col("all_match")).alias("running_balance_valid"),
    )
