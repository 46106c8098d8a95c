"""Column statistics from value counts: every distinct value is parsed once, however often it occurs."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType

from ledgerlens.config import ProfilingConfig
from ledgerlens.durable import materialize
from ledgerlens.functions import dates, money
from ledgerlens.operators.concepts import MONEY
from ledgerlens.operators.exact import long_number_statistics
from ledgerlens.operators.ordered import in_middle

COLUMN = ["file_id", "position", "name", "concept"]
MONEY_COLUMN = f"coalesce(concept IN {MONEY}, false)"
# Percentage of NULL values as a DOUBLE, 0 without rows.
NULL_SHARE = "coalesce(try_divide(CAST(null_count AS DOUBLE), row_count) * 100, 0D)"
# Rows of a file of parsed values; a row takes some 400 bytes in a sort.
VALUE_ROWS = 32_768
# Texts that count as booleans.
BOOLEANS = ("true", "false", "yes", "no", "0", "1")


def written_values(counts: DataFrame) -> DataFrame:
    """Parsed values, written in files so small that the sorts of those who read them stay small."""
    return materialize(parsed_values(counts), "values", VALUE_ROWS)


def value_counts(cells: DataFrame) -> DataFrame:
    """file_id, position, name, concept, value, cnt, first_row. Counted before the shuffle, too."""
    return cells.groupBy(*COLUMN, "value").agg(F.count(F.lit(1)).alias("cnt"), F.min("row_no").alias("first_row"))


def parsed_values(counts: DataFrame) -> DataFrame:
    """Adds ``number`` (STRUCT<valid, value, text>) and ``day`` (STRUCT<value, format, ambiguous>)."""
    return counts.withColumns(
        {"number": money.parse("value", MONEY_COLUMN), "day": dates.parse("value")}
    )


def _column_facts(parsed: DataFrame) -> DataFrame:
    """One row per column. Sums of numbers are kept exact by splitting a number into whole part and fraction."""
    filled = F.col("value") != ""
    cnt = F.col("cnt")
    number, valid = F.col("number.value"), F.col("number.valid") & filled
    day, ambiguous = F.col("day.value"), F.col("day.ambiguous") & filled

    def rows_with(condition: Column) -> Column:
        return F.sum(F.when(condition, cnt).otherwise(0))

    weight = cnt.cast("decimal(19,0)")
    whole = F.floor(number)
    fraction = ((number - F.floor(number)) * F.lit(10_000_000_000).cast("decimal(11,0)")).cast("decimal(10,0)")

    def total(*factors: Column) -> Column:
        product = factors[0].cast("decimal(38,0)")
        for factor in factors[1:]:
            product = F.try_multiply(product, factor).cast("decimal(38,0)")
        return F.try_sum(F.when(valid, product))

    low = F.struct(number.alias("v"), F.col("first_row").alias("r"), F.col("number.text").alias("t"))
    high = F.struct(number.alias("v"), (-F.col("first_row")).alias("r"), F.col("number.text").alias("t"))
    length = F.char_length("value")
    return parsed.groupBy(*COLUMN).agg(
        F.sum("cnt").alias("rows"),
        rows_with(~filled).alias("nulls"),
        F.count(F.when(filled, 1)).alias("distinct"),
        rows_with(valid).alias("numbers"),
        rows_with(valid & number.isNull()).alias("too_large"),
        rows_with(valid & money.is_whole(F.col("number.text"))).alias("integers"),
        rows_with(day.isNotNull() & filled).alias("dates"),
        rows_with(ambiguous).alias("ambiguous"),
        rows_with(dates.is_midnight(day) & filled).alias("midnights"),
        rows_with(F.lower("value").isin(*BOOLEANS)).alias("booleans"),
        F.max(money.has_currency_mark(F.col("value"))).alias("currency_mark"),
        F.min(F.when(valid & number.isNotNull(), low)).alias("low"),
        F.max(F.when(valid & number.isNotNull(), high)).alias("high"),
        total(weight, whole).alias("s_whole"),
        total(weight, fraction).alias("s_fraction"),
        total(weight, whole, whole).alias("q_whole"),
        total(weight, whole, fraction).alias("q_cross"),
        total(weight, fraction, fraction).alias("q_fraction"),
        F.min(F.when(filled, F.col("value"))).alias("min_text"),
        F.max(F.when(filled, F.col("value"))).alias("max_text"),
        F.min(F.when(filled, length)).alias("min_length"),
        F.max(F.when(filled, length)).alias("max_length"),
        F.sum(F.when(filled, length.cast("bigint") * cnt)).alias("sum_length"),
        F.min(F.when(filled, day)).alias("min_day"),
        F.max(F.when(filled, day)).alias("max_day"),
        F.bit_or(F.when(filled, dates.format_bit(F.col("day.format"))).otherwise(0)).alias("format_bits"),
    )


def inferred_type() -> Column:
    """Type of a column of facts; the first rule that holds decides."""
    some = F.col("rows") > F.col("nulls")
    filled = F.col("rows") - F.col("nulls")
    concept = F.coalesce(F.col("concept"), F.lit(""))
    return (
        F.when((concept == "transaction_date") & (F.col("dates") > 0), "date")
        .when(concept == "identifier", "identifier")
        .when(
            some & (F.col("numbers") == filled),
            F.when(concept.isin(*MONEY), "currency")
            .when(F.col("integers") == filled, "integer")
            .otherwise("decimal"),
        )
        .when(
            some & (F.col("dates") + F.col("ambiguous") == filled),
            F.when(F.col("midnights") == F.col("dates"), "date").otherwise("datetime"),
        )
        .when(some & (F.col("booleans") == filled), "boolean")
        .otherwise("text")
    )


def _spread() -> Callable[..., Column]:
    # Exact population standard deviation of one row per column; no decimal type is wide enough for the squares.
    def spread(
        n: pd.Series, s_whole: pd.Series, s_fraction: pd.Series, q_whole: pd.Series, q_cross: pd.Series, q_fraction: pd.Series
    ) -> pd.Series:
        import math
        from decimal import Context, Decimal

        wide = Context(prec=200)
        unit = 10**10

        def one(parts: tuple) -> Decimal | None:
            if any(p is None for p in parts) or not parts[0]:
                return None
            count, sw, sf, qw, qc, qf = map(int, parts)
            total, squares = sw * unit + sf, (qw * unit + 2 * qc) * unit + qf
            # twice the deviation in millionths, cut off, so that a half is seen exactly
            twice = math.isqrt(4 * 10**12 * (count * squares - total * total) // (count * unit) ** 2)
            return Decimal((twice + 1) // 2).scaleb(-6, wide)

        return pd.Series([one(p) for p in zip(n, s_whole, s_fraction, q_whole, q_cross, q_fraction)], dtype=object)

    return F.pandas_udf(spread, DecimalType(24, 6))


def column_statistics(parsed: DataFrame, config: ProfilingConfig = ProfilingConfig()) -> DataFrame:
    """All statistics of a column but samples and median; also ``numbers`` and ``distinct`` for the rules.

    Columns with numbers that no DECIMAL holds take their figures, and ``long_median``, from ``operators.exact``.
    """
    kind = F.col("kind")
    numeric = kind.isin("integer", "decimal", "currency") & (F.col("numbers") > 0)
    dated = kind.isin("date", "datetime") & (F.col("dates") > 0)
    textual = kind.isin("text", "identifier") & F.col("min_text").isNotNull()
    # where not all numbers are held exactly, the figures come from limbs
    exact = numeric & (F.col("too_large") == 0)
    counted = F.col("numbers")
    fractions = F.col("s_fraction").try_cast("decimal(26,0)") * F.lit(Decimal("0.0000000001"))
    total = F.col("s_whole").try_cast("decimal(27,0)") + fractions.cast("decimal(37,10)")
    facts = materialize(_column_facts(parsed).withColumn("kind", inferred_type()), "facts")
    long_columns = facts.where(numeric & (F.col("too_large") > 0)).select("file_id", "position")
    stats = facts.select(
        "file_id",
        F.col("position").cast("int").alias("column_position"),
        F.col("name").alias("column_name"),
        "concept",
        kind.alias("inferred_data_type"),
        F.col("rows").alias("row_count"),
        F.col("nulls").alias("null_count"),
        (F.col("rows") - F.col("nulls")).alias("non_null_count"),
        F.expr(NULL_SHARE.replace("null_count", "nulls").replace("row_count", "rows"))
        .cast("decimal(7,4)")
        .alias("null_percentage"),
        F.col("distinct").alias("unique_count"),
        F.greatest(F.col("rows") - F.col("nulls") - F.col("distinct"), F.lit(0)).alias("duplicate_value_count"),
        F.when(exact, F.col("low.t"))
        .when(dated, F.date_format("min_day", "yyyy-MM-dd"))
        .when(textual, F.col("min_text"))
        .alias("minimum_value"),
        F.when(exact, F.col("high.t"))
        .when(dated, F.date_format("max_day", "yyyy-MM-dd"))
        .when(textual, F.col("max_text"))
        .alias("maximum_value"),
        F.when(exact, F.try_divide(total, counted.cast("decimal(19,0)"))).try_cast("decimal(24,6)").alias("mean_value"),
        F.when(
            exact,
            _spread()(counted, *[F.col(c) for c in ("s_whole", "s_fraction", "q_whole", "q_cross", "q_fraction")]),
        ).alias("standard_deviation"),
        F.when(textual, F.col("min_length")).alias("minimum_length"),
        F.when(textual, F.col("max_length")).alias("maximum_length"),
        F.when(textual, F.try_divide(F.col("sum_length").cast("decimal(20,0)"), (F.col("rows") - F.col("nulls")).cast("decimal(20,0)")))
        .cast("decimal(12,4)")
        .alias("average_length"),
        F.when(dated, F.col("min_day").cast("date")).alias("earliest_date"),
        F.when(dated, F.col("max_day").cast("date")).alias("latest_date"),
        F.when(numeric, F.array(F.when(F.col("currency_mark"), "currency").otherwise("numeric")))
        .when(dated, dates.formats_of(F.col("format_bits")))
        .otherwise(F.array().cast("array<string>"))
        .alias("detected_formats"),
        dates.formats_of(F.col("format_bits")).alias("date_formats"),
        F.col("numbers").alias("number_count"),
        F.col("too_large").alias("overflow_count"),
        F.when(F.col("distinct") == 1, F.col("min_text")).alias("only_value"),
        F.lit(None).cast("decimal(24,6)").alias("long_median"),
    )
    if long_columns.isEmpty():
        return stats
    found = long_number_statistics(parsed, long_columns).withColumnRenamed("median_value", "long_median")
    figures = [c for c in found.columns if c not in ("file_id", "column_position")]
    found = found.select("file_id", "column_position", *[F.col(c).alias(f"_{c}") for c in figures])
    joined = stats.join(found, ["file_id", "column_position"], "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in figures else F.col(c) for c in stats.columns])


def samples(counts: DataFrame, n: int = ProfilingConfig.max_samples) -> DataFrame:
    """First ``n`` distinct values of every column in order of first occurrence: file_id, position, sample_values.

    The rank limit is applied on both sides of the shuffle, so a column sends at most ``n`` rows per task.
    """
    first = Window.partitionBy("file_id", "position").orderBy("first_row", "value")
    ranked = counts.filter(F.col("value") != "").withColumn("rank", F.row_number().over(first))
    return (
        ranked.filter(F.col("rank") <= n)
        .groupBy("file_id", "position")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v"))
        .select("file_id", "position", F.col("v.value").alias("sample_values"))
    )


def number_counts(parsed: DataFrame) -> DataFrame:
    """Distinct numbers of every column with their row counts: file_id, position, number, cnt."""
    return (
        parsed.filter((F.col("value") != "") & F.col("number.value").isNotNull())
        .select("file_id", "position", F.col("number.value").alias("number"), "cnt")
        .groupBy("file_id", "position", "number")
        .agg(F.sum("cnt").alias("cnt"))
    )


def medians(numbers: DataFrame) -> DataFrame:
    """Exact median of every column: file_id, position, median_value."""
    column = ["file_id", "position"]
    return in_middle(numbers, column).select(
        *column,
        ((F.col("a").cast("decimal(30,10)") + F.col("b")) / F.lit(2).cast("decimal(1,0)"))
        .try_cast("decimal(24,6)")
        .alias("median_value"),
    )


def column_profiles(
    counts: DataFrame,
    config: ProfilingConfig = ProfilingConfig(),
    *,
    headers: DataFrame | None = None,
) -> DataFrame:
    """One row per column. With ``headers`` columns of files without rows are included.

    ``counts`` may be parsed already; three branches read it, so a written table spares parsing it again.
    """
    parsed = counts if "number" in counts.columns else parsed_values(counts)
    key = ["file_id", "column_position"]
    stats = column_statistics(parsed, config)
    if headers is not None:
        empty = header_columns_without_rows(headers, stats)
        stats = stats.unionByName(empty)
    extra = samples(counts, config.max_samples).withColumnRenamed("position", "column_position")
    middle = medians(number_counts(parsed)).withColumnRenamed("position", "column_position")
    numeric = F.col("inferred_data_type").isin("integer", "decimal", "currency")
    return (
        stats.join(extra, key, "left")
        .join(middle, key, "left")
        .withColumns(
            {
                "median_value": F.when(numeric & (F.col("overflow_count") == 0), F.col("median_value")).otherwise(F.col("long_median")),
                "sample_values": F.coalesce("sample_values", F.array().cast("array<string>")),
                "original_data_type": F.lit("string"),
            }
        )
        .drop("long_median")
    )


def header_columns_without_rows(headers: DataFrame, stats: DataFrame) -> DataFrame:
    """Profiles of header columns that have no row at all; ``headers`` as from ``header_cells``."""
    nothing = headers.select("file_id", F.col("position").cast("int").alias("column_position"), "name", "concept").join(
        stats.select("file_id", "column_position"), ["file_id", "column_position"], "left_anti"
    )
    values = {
        "file_id": F.col("file_id"),
        "column_position": F.col("column_position"),
        "column_name": F.col("name"),
        "concept": F.col("concept"),
        "inferred_data_type": F.when(F.col("concept") == "identifier", "identifier").otherwise("text"),
        "detected_formats": F.array().cast("array<string>"),
        "date_formats": F.array().cast("array<string>"),
    }
    zeros = {"row_count", "null_count", "non_null_count", "null_percentage", "unique_count", "duplicate_value_count",
             "number_count", "overflow_count"}
    return nothing.select(
        *[
            values.get(f.name, F.lit(0 if f.name in zeros else None)).cast(f.dataType).alias(f.name)
            for f in stats.schema.fields
        ]
    )
