"""Data-quality rules. Every rule yields rows of the same shape, so that all findings are one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerlens.config import ProfilingConfig
from ledgerlens.functions import dates, money
from ledgerlens.functions.text import issue_fingerprint
from ledgerlens.operators.columns import NULL_SHARE
from ledgerlens.operators.concepts import MONEY, NOT_NULL
from ledgerlens.operators.ordered import block_of

# Severity and message of every finding.
RULES = {
    "unsupported_encoding": ("critical", "CSV encoding is not supported."),
    "empty_file": ("critical", "The registered CSV is empty."),
    "missing_header": ("critical", "The CSV does not contain a usable header."),
    "blank_column_name": ("error", "A column name is blank."),
    "duplicate_column_name": ("error", "A column name occurs more than once."),
    "completely_empty_row": ("info", "The row is completely empty."),
    "row_too_many_fields": ("error", "The row has more fields than the header."),
    "row_too_few_fields": ("error", "The row has fewer fields than the header."),
    "profiling_row_limit": ("warning", "Profiling stopped at the configured row safety limit."),
    "duplicate_rows": ("warning", "Found %d duplicate data row(s)."),
    "required_financial_field_not_found": ("warning", "No amount, debit, or credit candidate column was found."),
    "unexpected_null_value": ("warning", "A financial candidate column contains a null value."),
    "invalid_monetary_value": ("error", "Value cannot be parsed as money."),
    "ambiguous_date": ("warning", "Date is ambiguous and was not accepted."),
    "invalid_date_value": ("error", "Value cannot be parsed as a supported date."),
    "invalid_numeric_value": ("error", "Value is inconsistent with the numeric values in this column."),
    "inconsistent_date_formats": ("warning", "Column contains multiple date formats."),
    "all_null_column": ("warning", "Column contains only null values."),
    "constant_value_column": ("info", "Column contains one constant value."),
    "high_null_percentage": ("warning", "Column null percentage exceeds the configured threshold."),
    "missing_transaction_identifier": ("error", "Transaction identifier is missing."),
    "duplicate_transaction_identifier": ("error", "Transaction identifier is duplicated."),
    "running_balance_not_verifiable": (
        "warning",
        "Running balance cannot be reliably validated from available columns.",
    ),
    "invalid_running_balance": ("error", "Reported running balance does not match calculated balance."),
    "unexpected_negative_balance": ("warning", "Running balance is negative."),
}
# Fixed value: share of numbers from which the other values of an ordinary column are findings.
NUMERIC_SHARE = 0.8

_FIELDS = (
    ("file_id", "string"),
    ("column_name", "string"),
    ("row_number", "bigint"),
    ("issue_code", "string"),
    ("issue_type", "string"),
    ("severity", "string"),
    ("message", "string"),
    ("observed_value", "string"),
    ("expected_value", "string"),
)


def _finding(
    rule: str,
    column: str = "NULL",
    row: str = "NULL",
    observed: str = "NULL",
    expected: str = "NULL",
    message: str | None = None,
) -> str:
    """SQL struct of one finding; the arguments are SQL over the columns at hand."""
    severity, text = RULES[rule]
    code = "invalid_date_value" if rule == "ambiguous_date" else rule
    values = (column, row, f"'{code}'", "'data_quality'", f"'{severity}'", message or f"'{text}'", observed, expected)
    fields = (f"'{name}', CAST({v} AS {kind})" for (name, kind), v in zip(_FIELDS[1:], values))
    return f"named_struct({', '.join(fields)})"


def _case(*branches: tuple[str, str]) -> str:
    """The first finding whose condition holds, else NULL."""
    return "CASE " + " ".join(f"WHEN {condition} THEN {found}" for condition, found in branches) + " END"


def _emit(df: DataFrame, *findings: str) -> DataFrame:
    """All findings (SQL, NULL where a rule does not apply) of every row, worked out in one pass."""
    return df.selectExpr("file_id", f"inline(array_compact(array({', '.join(findings)})))")


_USABLE = "exists(names, n -> n <> '')"


def file_class_rules(classified: DataFrame) -> DataFrame:
    """``classified`` as from ``classify_files``."""
    return _emit(
        classified,
        _case(
            ("file_class = 'unsupported_encoding'", _finding("unsupported_encoding")),
            ("file_class = 'empty_file'", _finding("empty_file")),
        ),
    )


def header_rules(headers: DataFrame) -> DataFrame:
    """``headers`` as from ``extract_headers``: missing, blank and repeated column names."""
    missing = _emit(headers, _case(("NOT usable", _finding("missing_header"))))
    columns = headers.filter("usable").selectExpr("file_id", "names", "posexplode(names) AS (position, name)")
    blank = _finding("blank_column_name", row="1", observed="position + 1")
    repeated = "size(filter(names, n -> n = name)) > 1"
    names = _emit(
        columns, _case(("name = ''", blank), (repeated, _finding("duplicate_column_name", column="name")))
    )
    return missing.unionByName(names)


def concept_rules(headers: DataFrame) -> DataFrame:
    """Files with a usable header but no amount, debit or credit column."""
    known = "arrays_overlap(array_compact(concepts), array('amount', 'debit', 'credit'))"
    return _emit(
        headers.filter("usable"), _case((f"NOT {known}", _finding("required_financial_field_not_found")))
    )


def shape_rules(records: DataFrame) -> DataFrame:
    """Blank records and records wider or narrower than the header; ``records`` as written, header included."""
    sized = dict(row="record_no", observed="size(fields)", expected="size(names)")
    return _emit(
        records.filter(f"record_no > 1 AND (row_no IS NULL OR size(fields) <> size(names)) AND {_USABLE}"),
        _case(
            ("row_no IS NULL", _finding("completely_empty_row", row="record_no")),
            ("size(fields) > size(names)", _finding("row_too_many_fields", **sized)),
            ("size(fields) < size(names)", _finding("row_too_few_fields", **sized)),
        ),
    )


def count_rules(counts: DataFrame, config: ProfilingConfig = ProfilingConfig()) -> DataFrame:
    """Row limit reached and duplicate rows; ``counts`` as from ``file_counts``."""
    limit = "false" if config.max_rows is None else f"row_count >= {config.max_rows}"
    message = f"format_string('{RULES['duplicate_rows'][1]}', duplicate_row_count)"
    duplicates = _finding("duplicate_rows", observed="duplicate_row_count", message=message)
    return _emit(
        counts, _case((limit, _finding("profiling_row_limit"))), _case(("duplicate_row_count > 0", duplicates))
    )


def cell_rules(cells: DataFrame) -> DataFrame:
    """Findings about single cells of financial columns; at most one per cell, in one pass without a shuffle."""
    where = dict(column="name", row="row_no")
    observed = dict(**where, observed="value")
    # The parsers run only on the columns they are for.
    day = _case(
        ("_day.ambiguous", _finding("ambiguous_date", **observed)),
        ("_day.value IS NULL", _finding("invalid_date_value", **observed)),
    )
    # Findings are made by interpreted code, so what most cells pass is told before, and only the others go on.
    told = cells.filter("concept IS NOT NULL").withColumns(
        {
            "_money": F.expr(f"CASE WHEN concept IN {MONEY} THEN {money.parse_sql('value')}.valid END"),
            "_day": F.expr(f"CASE WHEN concept = 'transaction_date' THEN {dates.parse_sql('value')} END"),
        }
    )
    return _emit(
        told.filter("value = '' OR NOT _money OR (concept = 'transaction_date' AND (_day.ambiguous OR _day.value IS NULL))"),
        _case(
            (f"value = '' AND concept IN {NOT_NULL}", _finding("unexpected_null_value", **where)),
            ("value = '' AND concept = 'identifier'", _finding("missing_transaction_identifier", **where)),
            ("NOT _money", _finding("invalid_monetary_value", **observed)),
            ("concept = 'transaction_date'", day),
        ),
    )


def repeated_identifier_rules(cells: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Every row that holds a repeated identifier.

    One identifier may fill a large part of all rows, so rows are joined on (identifier, block of rows).
    """
    ids = cells.filter("concept = 'identifier' AND value <> ''").withColumn("block", block_of("row_no", block_rows))
    key = ["file_id", "position", "value"]
    occurring = ids.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("cnt"))
    repeated = occurring.groupBy(*key).agg(F.sum("cnt").alias("cnt")).filter("cnt > 1")
    blocks = occurring.join(repeated, key, "left_semi")
    return _emit(
        ids.join(blocks.select(*key, "block"), [*key, "block"], "left_semi"),
        _finding("duplicate_transaction_identifier", column="name", row="row_no", observed="value"),
    )


def mostly_numeric(columns: DataFrame) -> DataFrame:
    """Ordinary columns in which most, but not all, values are numbers."""
    numbers, filled = F.col("number_count"), F.col("non_null_count")
    return columns.filter(
        F.col("concept").isNull() & (numbers > 0) & (numbers < filled) & (numbers / filled >= NUMERIC_SHARE)
    )


def numeric_rules(
    cells: DataFrame, columns: DataFrame, block_rows: int | None = None, few_columns: bool = False
) -> DataFrame:
    """Values that are no numbers in mostly numeric columns; ``columns`` as from ``column_statistics``.

    With ``few_columns`` (the caller has counted them) the columns are broadcast. Otherwise cells are joined
    per block of rows, so that no column, however long, is one join key. Only cells of such columns are parsed.
    """
    suspects = mostly_numeric(columns).select("file_id", F.col("column_position").alias("position"), "row_count")
    filled = cells.filter("concept IS NULL AND value <> ''")
    if few_columns:
        found = filled.join(F.broadcast(suspects.drop("row_count")), ["file_id", "position"], "left_semi")
    else:
        blocks = F.sequence(F.lit(0).cast("bigint"), block_of(F.col("row_count") + 1, block_rows))
        found = filled.withColumn("block", block_of("row_no", block_rows)).join(
            suspects.select("file_id", "position", F.explode(blocks).alias("block")),
            ["file_id", "position", "block"],
            "left_semi",
        )
    other = _finding("invalid_numeric_value", column="name", row="row_no", observed="value")
    return _emit(found.filter(f"NOT {money.parse_sql('value', 'false')}.valid"), other)


def column_rules(columns: DataFrame, config: ProfilingConfig = ProfilingConfig()) -> DataFrame:
    """Findings about whole columns; several may apply to one."""
    threshold = float(config.null_percentage_threshold)
    share = NULL_SHARE
    formats = _finding("inconsistent_date_formats", column="column_name", observed="array_join(date_formats, ', ')")
    nulls = _finding(
        "high_null_percentage",
        column="column_name",
        observed=f"concat(format_number({share}, 2), '%')",
        expected=f"'<{threshold:.2f}%'",
    )
    constant = _finding("constant_value_column", column="column_name", observed="only_value")
    return _emit(
        columns,
        _case(("size(date_formats) > 1", formats)),
        _case(("non_null_count = 0", _finding("all_null_column", column="column_name"))),
        _case(("unique_count = 1 AND non_null_count > 1", constant)),
        _case((f"{share} >= {threshold!r}D AND non_null_count > 0", nulls)),
    )


def balance_rules(running: DataFrame) -> DataFrame:
    """``running`` as from ``running_balance``."""
    where = dict(column="balance_name", row="row_no", observed="reported_text")
    return _emit(
        running.filter("NOT matches OR negative"),
        _case(("NOT matches", _finding("invalid_running_balance", **where, expected="expected_text"))),
        _case(("negative", _finding("unexpected_negative_balance", **where))),
    )


def verifiability_rules(summary: DataFrame) -> DataFrame:
    """``summary`` as from ``balance_summary``."""
    return _emit(summary, _case(("NOT verifiable", _finding("running_balance_not_verifiable"))))


def all_issues(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def with_fingerprints(issues: DataFrame, version: str = ProfilingConfig.version) -> DataFrame:
    return issues.withColumn(
        "issue_fingerprint",
        issue_fingerprint(F.col("file_id"), version, F.col("issue_code"), F.col("column_name"), F.col("row_number")),
    )


def dedupe_issues(issues: DataFrame) -> DataFrame:
    """One row per fingerprint; repeated columns of one name can find the same thing twice."""
    kept = [c for c in issues.columns if c != "issue_fingerprint"]
    return (
        issues.groupBy("issue_fingerprint").agg(F.min(F.struct(*kept)).alias("i")).select("i.*", "issue_fingerprint")
    )
