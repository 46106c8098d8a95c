"""Row shaping: records as written -> fitted records -> cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.text import strip


def trim_fields(records: DataFrame) -> DataFrame:
    return records.withColumn("fields", F.transform("fields", strip))


def is_blank(fields: str = "fields"):
    return F.forall(fields, lambda f: strip(f) == "")


def drop_empty(records: DataFrame) -> DataFrame:
    """Without records that have no field or only blank ones."""
    return records.filter(~is_blank())


def fit_width(records: DataFrame) -> DataFrame:
    """Cuts or pads ``fields`` to the width of ``names``; ``n_fields`` keeps the width as written."""
    width = F.size("names")
    short = F.greatest(width - F.size("fields"), F.lit(0))
    return records.withColumn("n_fields", F.size("fields")).withColumn(
        "fields", F.concat(F.slice("fields", F.lit(1), width), F.array_repeat(F.lit(""), short))
    )


def data_records(records: DataFrame) -> DataFrame:
    """Kept rows of files with a usable header: trimmed and fitted."""
    usable = F.exists("names", lambda name: name != "")
    return fit_width(trim_fields(records.filter(F.col("row_no").isNotNull() & usable)))


def limit_rows(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` kept rows of every file; nothing after the n-th one is left, blank records included.

    Rows tell by their number; only blank records are joined to where their file stops.
    """
    numbered = records.filter((F.col("record_no") == 1) | (F.col("row_no") <= n + 1))
    last = records.filter(F.col("row_no") == n + 1).select("file_id", F.col("record_no").alias("_last"))
    blank = (
        records.filter((F.col("record_no") > 1) & F.col("row_no").isNull())
        .join(last, "file_id", "left")
        .filter(F.col("_last").isNull() | (F.col("record_no") < F.col("_last")))
        .drop("_last")
    )
    return numbered.unionByName(blank)


def to_cells(records: DataFrame) -> DataFrame:
    """One row per cell: file_id, record_no, row_no, position, name, concept, value.

    Every record has at least one field. The outer form keeps Spark from testing that on each record.
    """
    exploded = F.posexplode_outer("fields").alias("position", "value")
    return records.select("file_id", "record_no", "row_no", "names", "concepts", exploded).select(
        "file_id",
        "record_no",
        "row_no",
        "position",
        F.get("names", F.col("position")).alias("name"),
        F.get("concepts", F.col("position")).alias("concept"),
        "value",
    )


def header_cells(headers: DataFrame) -> DataFrame:
    """One row per column of every file: file_id, position, name, concept."""
    return headers.select("file_id", "concepts", F.posexplode("names").alias("position", "name")).select(
        "file_id", "position", "name", F.get("concepts", F.col("position")).alias("concept")
    )
