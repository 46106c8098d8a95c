"""Tables with a group key: every group is treated like one file, every value as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.text import strip
from ledgerlens.operators.concepts import MONEY, literal_concepts
from ledgerlens.operators.ordered import number_rows
from ledgerlens.operators.shaping import to_cells


def as_text(c: str | Column) -> Column:
    return F.coalesce(strip((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(""))


def records_from_table(
    df: DataFrame, group_key: str, columns: list[str], *, order_keys: list[str] | None = None, row_no: str | None = None
) -> DataFrame:
    """Records of a table: file_id, record_no, row_no, names, concepts, fields.

    The row order comes from ``order_keys``, or from a column that already numbers the rows of a group
    from 2 (``row_no``). The names are literals, so only the columns in use are read.
    """
    if (order_keys is None) == (row_no is None):
        raise ValueError("give either order_keys or row_no")
    if row_no is None:
        df = number_rows(df, [group_key], order_keys, name="_row_no", first=2)
        row_no = "_row_no"
    concepts = literal_concepts(df.sparkSession, columns)
    return df.select(
        F.col(group_key).cast("string").alias("file_id"),
        F.col(row_no).cast("bigint").alias("record_no"),
        F.col(row_no).cast("bigint").alias("row_no"),
        F.array(*[F.lit(c) for c in columns]).alias("names"),
        F.array(*[F.lit(c).cast("string") for c in concepts]).alias("concepts"),
        F.array(*[as_text(c) for c in columns]).alias("fields"),
    )


def ledger_from_table(df: DataFrame, group_key: str, columns: list[str], row_no: str) -> DataFrame:
    """The ledger view of a table (see ``ledger_view``); reads the money columns only."""
    found = literal_concepts(df.sparkSession, columns)
    first = {c: columns[found.index(c)] for c in MONEY if c in found}
    absent = F.lit(None).cast("string")
    return df.select(
        F.col(group_key).cast("string").alias("file_id"),
        F.col(row_no).cast("bigint").alias("row_no"),
        (F.lit(first["balance"]) if "balance" in first else absent).alias("balance_name"),
        *[(as_text(first[c]) if c in first else absent).alias(c) for c in MONEY],
    )


def cells_from_table(
    df: DataFrame, group_key: str, columns: list[str], *, order_keys: list[str] | None = None, row_no: str | None = None
) -> DataFrame:
    return to_cells(records_from_table(df, group_key, columns, order_keys=order_keys, row_no=row_no))
