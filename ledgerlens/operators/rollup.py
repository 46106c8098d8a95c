"""Figures per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_rows(records: DataFrame) -> DataFrame:
    """file_id, duplicate_row_count: rows beyond the first of every distinct row.

    Equal rows are counted before the shuffle, on the fields themselves.
    """
    return (
        records.groupBy("file_id", "fields")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .groupBy("file_id")
        .agg(F.sum(F.col("cnt") - 1).alias("duplicate_row_count"))
    )


def record_counts(records: DataFrame) -> DataFrame:
    """file_id, row_count, column_count, empty_row_count; ``records`` as written, header included."""
    usable = F.exists("names", lambda name: name != "")
    body = usable & (F.col("record_no") > 1)
    return records.groupBy("file_id").agg(
        F.count(F.when(body & F.col("row_no").isNotNull(), 1)).alias("row_count"),
        F.max(F.size("names")).cast("bigint").alias("column_count"),
        F.count(F.when(body & F.col("row_no").isNull(), 1)).alias("empty_row_count"),
    )


def file_counts(raw: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts per file from the records as written and the kept, fitted rows."""
    return (
        record_counts(raw)
        .join(duplicate_rows(rows), "file_id", "left")
        .withColumn("duplicate_row_count", F.coalesce("duplicate_row_count", F.lit(0).cast("bigint")))
    )


def rollup_files(columns: DataFrame) -> DataFrame:
    """Column profiles summed up per file."""
    kind = F.col("inferred_data_type")

    def having(*kinds: str):
        return F.count(F.when(kind.isin(*kinds), 1))

    return columns.groupBy("file_id").agg(
        F.sum("null_count").alias("total_null_count"),
        F.sum("non_null_count").alias("total_non_null_count"),
        having("integer", "decimal", "currency").alias("total_numeric_columns"),
        having("date", "datetime").alias("total_date_columns"),
        having("text", "identifier").alias("total_text_columns"),
        having("boolean").alias("total_boolean_columns"),
        F.min("earliest_date").alias("date_range_start"),
        F.max("latest_date").alias("date_range_end"),
    )


def profile_status(issues: DataFrame) -> DataFrame:
    """file_id, status of every file that has a finding; a file without one is ``completed``."""
    return issues.groupBy("file_id").agg(
        F.when(F.max(F.col("severity") == "critical"), "blocked")
        .otherwise("completed_with_warnings")
        .alias("status")
    )


def issue_totals(issues: DataFrame, key: str = "file_id") -> DataFrame:
    """Findings per severity as a map. The severities are few, so a group's map is small."""
    return (
        issues.groupBy(key, "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(key)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("issue_totals"))
    )
