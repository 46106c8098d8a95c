"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from entry_queries import inputs as I, more_inputs as M
from ledgerlens.config import ProfilingConfig, RegistrationConfig
from ledgerlens.durable import scratch_path
from ledgerlens.functions import dates, money, text
from ledgerlens.operators import columns as C, concepts, ledger as L, ordered, reads, registration, rollup, rules, shaping
from ledgerlens.plans import profile as P, register as R
from ledgerlens.sources import corpus as K, tables
from ledgerlens.sources.catalog import Catalog, latest_of_files
from ledgerlens.streaming.intake import landing_stream, start_intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_catalogs: dict[tuple[str, str, str], Catalog] = {}
TABLE_CONFIG = ProfilingConfig(max_rows=None)
# For the queries that show the size limit.
LANDING_CONFIG = RegistrationConfig(max_bytes=16_000)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(name: str) -> Column:
    return F.array_join(name, "¦").alias(name)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.to_cells(I.ledger_records(spark, sf_dir))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.value_counts(cells(spark, sf_dir))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counting, parsing and sorting in one task would need memory as the parts of the shuffle grow; what is read back comes by ranges
    return C.column_statistics(C.written_values(counts(spark, sf_dir)))


def texts(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]


# --- scalar functions -------------------------------------------------------------------------------------


@query
def x1_parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.money_texts(spark, sf_dir).withColumn("p", money.parse("v"))
    return df.select("event_id", "p.valid", F.col("p.value").cast("string").alias("amount"), F.col("p.text").alias("normalized"))


@query
def x2_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.money_texts(spark, sf_dir).withColumn("p", money.parse("v", "false"))
    return df.select("event_id", "p.valid", F.col("p.value").cast("string").alias("amount"), F.col("p.text").alias("normalized"))


@query
def x3_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.date_texts(spark, sf_dir).withColumn("p", dates.parse("v"))
    return df.select(
        "event_id",
        F.date_format("p.value", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"),
        "p.format",
        "p.ambiguous",
    )


@query
def x8_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = M.headers(spark, sf_dir).select("file_id", F.transform("header", text.strip).alias("names"))
    return shaping.header_cells(named.withColumn("concepts", concepts.concepts_of("names")))


@query
def x10_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.landed_documents(spark, sf_dir).select(
        "doc_id", text.sanitize_filename(F.col("original_filename")).alias("sanitized")
    )


@query
def x11_checksum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.landed_documents(spark, sf_dir).select(
        "doc_id", F.sha2("content", 256).alias("checksum"), text.sanitize_filename(F.col("path")).alias("name")
    )
    stored = text.stored_filename(F.col("checksum"), F.col("name"))
    return df.select("doc_id", "checksum", stored.alias("stored_filename"), text.relative_path(stored).alias("relative_path"))


@query
def x17_profile_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = M.headers(spark, sf_dir).select("file_id", F.transform("header", text.strip).alias("names"))
    named = named.withColumn("concepts", concepts.concepts_of("names"))
    return named.select("file_id", P.profile_metadata(F.col("names"), F.col("concepts")).alias("metadata"))


# --- files ------------------------------------------------------------------------------------------------


@query
def s1_corpus_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = I.ledger_files(spark, sf_dir).select(F.col("file_id").alias("source_file_id"), "file_key")
    folder = M.corpus_folder(spark, sf_dir, ~F.col("file_key").endswith("3-0"))
    return K.missing_files(registered, K.read_corpus(spark, folder))


@query
def s2_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_encoding(M.encoded_files(spark, sf_dir)).select(
        "doc_id", "encoding", F.char_length("text").cast("string").alias("characters")
    )


@query
def s3_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = K.with_encoding(I.ledger_files(spark, sf_dir))
    found = K.detect_delimiters(files)
    return files.select("file_id", "file_key").join(found, "file_id").select("file_key", "delimiter")


@query
def s4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = M.corpus_folder(spark, sf_dir)
    records = K.raw_records(K.parse_folder(spark, folder, K.with_file_id(K.read_corpus(spark, folder))))
    return records.select("file_id", "record_no", joined("fields"))


def _flawed(spark: SparkSession, sf_dir: str, max_rows: int | None = None) -> DataFrame:
    files = I.ledger_files(spark, sf_dir, flawed=True).withColumn("file_id", F.col("file_key"))
    return K.raw_records(K.parse_files(K.with_encoding(files), max_rows))


@query
def s5_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.header_cells(K.extract_headers(_flawed(spark, sf_dir)))


@query
def s6_file_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classify_files(K.with_encoding(M.encoded_files(spark, sf_dir))).select("doc_id", "file_class")


@query
def s8_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = M.orders(spark, sf_dir)
    return tables.cells_from_table(
        table, "customer", M.ORDER_COLUMNS, order_keys=["ordered_at", "order_key"]
    ).select("file_id", "row_no", "position", "name", "value")


# --- row shaping ------------------------------------------------------------------------------------------


@query
def p1_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.trim_fields(_flawed(spark, sf_dir)).select("file_id", "record_no", joined("fields"))


@query
def p2_fit_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.data_records(_flawed(spark, sf_dir)).select("file_id", "record_no", "n_fields", joined("fields"))


@query
def p4_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.drop_empty(_flawed(spark, sf_dir)).select("file_id", "record_no")


@query
def p5_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.limit_rows(_flawed(spark, sf_dir), 20).select(
        "file_id", "record_no", F.col("row_no").cast("string").alias("row_no")
    )


@query
def p5_parser_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flawed(spark, sf_dir, max_rows=20).select("file_id", "record_no", F.col("row_no").cast("string").alias("row_no"))


@query
def p6_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return ordered.number_rows(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "row_no")


@query
def p8_ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger_view(I.ledger_records(spark, sf_dir)).select(
        "file_id", "row_no", "balance_name", "amount", "balance", "debit"
    )


# --- columns ----------------------------------------------------------------------------------------------


@query
def a21_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir).select("file_id", "position", "value", "cnt", "first_row")


@query
def a3_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(spark, sf_dir).select(
        "file_id", "column_position", "row_count", "null_count", "non_null_count", *texts("null_percentage")
    )


@query
def a4_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(spark, sf_dir).select("file_id", "column_position", "unique_count", "duplicate_value_count")


@query
def a5_numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = statistics(spark, sf_dir).filter(F.col("inferred_data_type").isin("integer", "decimal", "currency"))
    return df.select(
        "file_id", "column_position", "minimum_value", "maximum_value", *texts("mean_value", "standard_deviation")
    )


@query
def a5_orders_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole orders table as one group: statistics of long columns."""
    table = M.orders(spark, sf_dir).withColumns({"all": F.lit("all"), "number": F.col("order_key") + 2})
    records = tables.records_from_table(table, "all", M.ORDER_COLUMNS, row_no="number")
    df = C.column_statistics(C.parsed_values(C.value_counts(shaping.to_cells(records))))
    return df.select(
        "column_name", "inferred_data_type", "unique_count", "minimum_value", "maximum_value",
        *texts("mean_value", "standard_deviation", "average_length", "earliest_date"),
    )


@query
def a5_long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 26 and of 40 digits: every figure but the deviation, which DuckDB has no type for; what 24 digits cannot hold is NULL."""
    rows = M.long_amounts(spark, sf_dir)
    found = []
    for name in ("value", "large"):
        cells = rows.select("file_id", "row_no", F.lit(0).alias("position"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("concept"), F.col(name).alias("value"))
        found.append(C.column_profiles(C.written_values(C.value_counts(cells))))
    df = found[0].unionByName(found[1])
    return df.select("file_id", "column_name", "inferred_data_type", "unique_count", "minimum_value", "maximum_value", *texts("mean_value", "median_value"))


@query
def a16_long_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    ledger = M.long_amounts(spark, sf_dir).select("file_id", "row_no", none.alias("balance_name"), F.col("value").alias("amount"), none.alias("balance"), F.col("large").alias("debit"), none.alias("credit"))
    return L.control_totals(ledger).select("file_id", *texts("monetary_total", "debit_total", "credit_total"))


@query
def a7_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = C.parsed_values(counts(spark, sf_dir))
    return C.medians(C.number_counts(parsed)).select("file_id", "position", *texts("median_value"))


@query
def a7_lineitem_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of all lines per return flag: few groups, each with very many distinct numbers."""
    lines = I.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("file_id"),
        F.lit(0).alias("position"),
        F.col("l_extendedprice").cast("decimal(28,10)").alias("number"),
    )
    numbers = lines.groupBy("file_id", "position", "number").agg(F.count(F.lit(1)).alias("cnt"))
    return C.medians(numbers).select("file_id", *texts("median_value"))


@query
def a9_date_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = statistics(spark, sf_dir).filter(F.col("inferred_data_type").isin("date", "datetime"))
    return df.select(
        "file_id", "column_position", "minimum_value", "maximum_value",
        *texts("earliest_date", "latest_date"), joined("detected_formats"),
    )


@query
def a11_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = statistics(spark, sf_dir).filter(F.col("inferred_data_type").isin("text", "identifier"))
    return df.select(
        "file_id", "column_position", "minimum_value", "maximum_value",
        *texts("minimum_length", "maximum_length", "average_length"),
    )


@query
def a13_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(spark, sf_dir).select("file_id", "column_position", "inferred_data_type")


@query
def a14_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(spark, sf_dir).select("file_id", "column_position", joined("detected_formats"))


@query
def w1_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.samples(counts(spark, sf_dir)).select("file_id", "position", joined("sample_values"))


# --- files rolled up --------------------------------------------------------------------------------------


@query
def a1_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.record_counts(_flawed(spark, sf_dir))


@query
def a2_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.duplicate_rows(shaping.data_records(_flawed(spark, sf_dir)))


@query
def a2_lineitem_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("file_id"),
        F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("fields"),
    )
    return rollup.duplicate_rows(lines)


@query
def a15_file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup_files(statistics(spark, sf_dir)).select(
        "file_id", "total_null_count", "total_non_null_count", "total_numeric_columns", "total_date_columns",
        "total_text_columns", "total_boolean_columns", *texts("date_range_start", "date_range_end"),
    )


# --- ledgers ----------------------------------------------------------------------------------------------


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ledger_from_table(I.ledger(spark, sf_dir), "file_id", I.LEDGER_COLUMNS, "row_no")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ledger_from_table(I.sides(spark, sf_dir), "file_id", I.SIDES_COLUMNS, "row_no")


def _totals(df: DataFrame) -> DataFrame:
    return df.select("file_id", *texts("monetary_total", "debit_total", "credit_total"))


def _running(df: DataFrame) -> DataFrame:
    expected = text.decimal_text(F.col("expected"), F.col("scale"))
    return df.select("file_id", "row_no", F.col("reported_text").alias("reported"), expected.alias("expected"), "matches")


def _summary(df: DataFrame) -> DataFrame:
    return df.select(
        "file_id", "verifiable",
        *texts("opening_balance", "closing_balance", "calculated_closing_balance", "running_balance_valid"),
    )


@query
def a16_control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(L.control_totals(ledger(spark, sf_dir)))


@query
def a16_side_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(L.control_totals(sides(spark, sf_dir)))


@query
def w3_closing_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.balance_summary(ledger(spark, sf_dir)).select("file_id", *texts("closing_balance"))


@query
def w4_running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(L.running_balance(ledger(spark, sf_dir)))


@query
def w4_side_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(L.running_balance(sides(spark, sf_dir)))


@query
def w5_balance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(L.balance_summary(ledger(spark, sf_dir)))


# --- rules ------------------------------------------------------------------------------------------------


def findings(df: DataFrame) -> DataFrame:
    return df.select(
        "file_id", "column_name", F.col("row_number").cast("string").alias("row_number"), "issue_code", "severity",
        "message", "observed_value", "expected_value",
    )


def only(df: DataFrame, *codes: str) -> DataFrame:
    return findings(df.filter(F.col("issue_code").isin(*codes)))


@query
def r_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = M.headers(spark, sf_dir).select("file_id", F.transform("header", text.strip).alias("names"))
    named = named.withColumn("usable", F.exists("names", lambda n: n != ""))
    issues = rules.with_fingerprints(rules.header_rules(named))
    return findings(rules.dedupe_issues(issues))


@query
def r_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = K.classify_files(K.with_encoding(M.encoded_files(spark, sf_dir)))
    named = M.headers(spark, sf_dir).select(
        F.concat(F.lit("header "), "file_id").alias("file_id"), F.transform("header", text.strip).alias("names")
    )
    named = named.withColumns(
        {"concepts": concepts.concepts_of("names"), "usable": F.exists("names", lambda n: n != "")}
    )
    raw = _flawed(spark, sf_dir)
    file_counts = rollup.file_counts(raw, shaping.data_records(raw))
    return findings(
        rules.all_issues(
            rules.file_class_rules(classes),
            rules.concept_rules(named),
            rules.count_rules(file_counts, ProfilingConfig(max_rows=60)),
        )
    )


@query
def r_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(rules.shape_rules(_flawed(spark, sf_dir)))


@query
def r_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    side_cells = shaping.to_cells(I.sides_records(spark, sf_dir))
    return only(rules.cell_rules(side_cells), "unexpected_null_value")


@query
def r_invalid_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(rules.cell_rules(cells(spark, sf_dir)), "invalid_monetary_value")


@query
def r_invalid_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(rules.cell_rules(cells(spark, sf_dir)), "invalid_date_value")


@query
def r_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(rules.cell_rules(cells(spark, sf_dir)), "missing_transaction_identifier")


@query
def r_duplicate_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(rules.repeated_identifier_rules(cells(spark, sf_dir)))


@query
def r_invalid_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(rules.numeric_rules(cells(spark, sf_dir), statistics(spark, sf_dir)))


@query
def r_column_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(rules.column_rules(statistics(spark, sf_dir)))


@query
def r_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = ledger(spark, sf_dir)
    return findings(
        rules.all_issues(
            rules.balance_rules(L.running_balance(view)), rules.verifiability_rules(L.balance_summary(view))
        )
    )


# --- whole profiles ---------------------------------------------------------------------------------------


def profiled(spark: SparkSession, sf_dir: str) -> P.Profile:
    return P.profile_records(I.ledger_records(spark, sf_dir), TABLE_CONFIG)


@query
def u1_all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(profiled(spark, sf_dir).issues)


@query
def u4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = profile_catalog(spark, sf_dir).latest_issues()
    return issues.select(F.col("source_file_id").alias("file_id"), "issue_fingerprint")


@query
def a17_issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = rollup.issue_totals(profile_catalog(spark, sf_dir).latest_issues(), "source_file_id")
    return totals.select(F.col("source_file_id").alias("file_id"), F.explode("issue_totals").alias("severity", "n"))


@query
def a18_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_catalog(spark, sf_dir).latest_profiles().select(F.col("source_file_id").alias("file_id"), "status")


def full_profile(columns: DataFrame) -> DataFrame:
    return columns.select(
        "file_id", "column_position", "column_name", "inferred_data_type", "row_count", "null_count", "non_null_count",
        "unique_count", "duplicate_value_count", "minimum_value", "maximum_value",
        *texts("null_percentage", "mean_value", "median_value", "standard_deviation", "minimum_length",
               "maximum_length", "average_length", "earliest_date", "latest_date"),
        joined("sample_values"), joined("detected_formats"),
    )


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every statistic of every column of every ledger."""
    values = C.written_values(counts(spark, sf_dir))
    return full_profile(C.column_profiles(values))


def file_profile(files: DataFrame) -> DataFrame:
    return files.select(
        "file_id", "status", "row_count", "column_count", "empty_row_count", "duplicate_row_count",
        "total_null_count", "total_non_null_count", "total_numeric_columns", "total_date_columns",
        "total_text_columns", "total_boolean_columns", "rule_issue_count",
        *texts("date_range_start", "date_range_end", "monetary_total", "debit_total", "credit_total",
               "opening_balance", "closing_balance", "calculated_closing_balance", "running_balance_valid"),
    )


@query
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_profile(profiled(spark, sf_dir).files)


# --- registration -----------------------------------------------------------------------------------------


def landing(spark: SparkSession, sf_dir: str, config: RegistrationConfig = RegistrationConfig()) -> DataFrame:
    return R.landing_of(M.landed_documents(spark, sf_dir), config).drop("doc_id")


@query
def f_register_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = registration.check_files(
        landing(spark, sf_dir, LANDING_CONFIG).drop("lang"), M.source_systems(spark, sf_dir), LANDING_CONFIG
    )
    return checked.select("path", "error_code", "error_message", "normalized_mime_type", "file_extension")


def two_waves(spark: SparkSession, sf_dir: str) -> tuple[R.Registration, R.Registration]:
    """English documents land first, the others later."""
    systems, landed = M.source_systems(spark, sf_dir), landing(spark, sf_dir, LANDING_CONFIG)
    empty = spark.createDataFrame([], "sha256_checksum STRING")
    early, late = landed.filter("lang = 'en'").drop("lang"), landed.filter("lang <> 'en'").drop("lang")
    first = R.register_batch(early, systems, empty, "wave-1", M.BATCH_TIME, LANDING_CONFIG)
    second = R.register_batch(late, systems, first.files, "wave-2", M.BATCH_TIME, LANDING_CONFIG)
    return first, second


@query
def j4_duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch without further checks: which copies are duplicates?"""
    files = landing(spark, sf_dir).withColumn("error_code", F.lit(None).cast("string"))
    empty = spark.createDataFrame([], "sha256_checksum STRING")
    return registration.mark_duplicates(files, empty).select("path", "outcome")


@query
def b1_register_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = two_waves(spark, sf_dir)
    return R.upload_responses(first.outcomes.unionByName(second.outcomes)).drop("run_id")


@query
def b2_register_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = two_waves(spark, sf_dir)
    runs, steps = first.runs.unionByName(second.runs), first.steps.unionByName(second.steps)
    return runs.join(steps.select("run_id", "step_name", "metadata_json"), "run_id").select(
        "run_id", "run_type", "status", "source_file_id", "error_message", "step_name", "metadata_json"
    )


@query
def k1_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both waves stored in a catalogue and read back."""
    return registered_catalog(spark, sf_dir).read("source_files").select(
        "source_file_id", "source_system_code", "original_filename", "stored_filename", "relative_path",
        "file_extension", "mime_type", "file_size_bytes", "status",
    )


def stored_registrations(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalogue of both waves, stored once per session and folder for the queries that only read it."""
    key = (spark.sparkContext.applicationId, sf_dir, "registrations")
    if key not in _catalogs:
        _catalogs[key] = registered_catalog(spark, sf_dir)
    return _catalogs[key]


def registered_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    systems, landed = M.source_systems(spark, sf_dir), landing(spark, sf_dir)
    catalog.append("source_systems", systems, "systems")
    catalog.commit("systems", M.BATCH_TIME)
    for batch_id, lang in (("wave-1", "lang = 'en'"), ("wave-2", "lang <> 'en'")):
        batch = R.register_batch(
            landed.filter(lang).drop("lang"), systems, catalog.read("source_files"), batch_id, M.BATCH_TIME
        )
        R.store_registration(catalog, batch, batch_id, M.BATCH_TIME)
    return catalog


@query
def j1_files_with_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = stored_registrations(spark, sf_dir)
    return reads.files_with_system(catalog.read("source_files"), catalog.read("source_systems")).select(
        "source_file_id", "original_filename", "source_system_code", "source_system_name"
    )


@query
def j2_runs_with_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = stored_registrations(spark, sf_dir)
    nested = reads.runs_with_steps(catalog.read("pipeline_runs"), catalog.read("pipeline_run_steps"))
    step = F.element_at("steps", 1)
    return nested.select(
        "run_id", "status", F.size("steps").alias("n_steps"), step["step_name"].alias("step_name"), step["status"].alias("step_status")
    )


@query
def t4_system_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.system_page(stored_registrations(spark, sf_dir).read("source_systems"), 2, 5).select("code", "name", "is_active")


@query
def t5_file_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.file_page(stored_registrations(spark, sf_dir).read("source_files"), 2, 20).select("source_file_id", "original_filename")


@query
def t6_run_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.run_page(stored_registrations(spark, sf_dir).read("pipeline_runs"), 3, 20).select("run_id", "status")


# --- stored profiles --------------------------------------------------------------------------------------




def profile_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The ledgers profiled and stored; done once per session and folder, as reads come after a stored batch."""
    key = (spark.sparkContext.applicationId, sf_dir, "profiles")
    if key not in _catalogs:
        catalog = Catalog(spark, scratch_path(spark, "catalog"))
        nothing = spark.createDataFrame([], "file_id STRING")
        result = P.stored_form(profiled(spark, sf_dir), nothing, "batch-1", M.BATCH_TIME, TABLE_CONFIG)
        P.store_profile(catalog, result, "batch-1", M.BATCH_TIME)
        _catalogs[key] = catalog
    return _catalogs[key]


@query
def f6_issue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.filter_issues(
        profile_catalog(spark, sf_dir).latest_issues(), severity="error", issue_code="invalid_date_value", status="open", column_name="posted_date"
    )
    return found.select("issue_fingerprint", "source_file_id", "row_number", "observed_value")


@query
def t1_issue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of warnings, and the total of the listing as one more row."""
    warnings = reads.filter_issues(profile_catalog(spark, sf_dir).latest_issues(), severity="warning")
    page = reads.issue_page(warnings, 3, 50)
    items = page.select("issue_fingerprint", "source_file_id", "issue_code")
    total = reads.total(warnings).select(F.col("total").cast("string").alias("total"))
    return items.unionByName(total, allowMissingColumns=True)


@query
def t2_profile_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reruns of one file, newest first."""
    first = profile_catalog(spark, sf_dir).latest_profiles()
    runs = first.unionByName(first.withColumns({"run_id": F.lit("rerun"), "generated_at": F.col("generated_at") + F.expr("INTERVAL 1 DAY")}))
    return reads.profile_page(runs, "8", 1, 20).select("source_file_id", "row_count", F.date_format("generated_at", "yyyy-MM-dd").alias("day"))


@query
def t3_column_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = profile_catalog(spark, sf_dir)
    wanted = catalog.latest_profiles().filter("source_file_id = '8'").first()["profile_id"]
    page = reads.column_page(catalog.latest_column_profiles(), wanted, 2, 4)
    return page.select("column_position", "column_name", "inferred_data_type")


@query
def t7_latest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest profile of every file, where some have a profile of a newer version."""
    profiles = profile_catalog(spark, sf_dir).latest_profiles()
    newer = profiles.filter("CAST(source_file_id AS INT) % 2 = 0").withColumns(
        {"profile_version": F.lit("2.0.0"), "run_id": F.lit("newer"), "generated_at": F.col("generated_at") + F.expr("INTERVAL 1 DAY")}
    )
    latest = latest_of_files(profiles.unionByName(newer))
    return latest.select("source_file_id", "profile_version", "row_count", F.date_format("generated_at", "yyyy-MM-dd").alias("day"))


@query
def j9_profile_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile with its file's name and size: the ledgers as files of 100 bytes a row."""
    profiles = profile_catalog(spark, sf_dir).latest_profiles()
    counts = I.ledger(spark, sf_dir).groupBy(F.col("file_id").alias("source_file_id")).agg(F.count("*").alias("n"))
    files = counts.withColumns({"original_filename": F.format_string("ledger %s.csv", "source_file_id"), "file_size_bytes": F.col("n") * 100})
    return reads.profiles_with_files(profiles, files).select("source_file_id", "row_count", "original_filename", "registered_size_bytes")


@query
def f7_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run and the profile of one ledger by their keys, with their parts."""
    catalog = profile_catalog(spark, sf_dir)
    wanted = catalog.latest_profiles().filter("source_file_id = '8'").first()
    profile = reads.profile_by_id(catalog.latest_profiles(), catalog.latest_issues(), wanted["profile_id"])
    run = reads.run_by_id(catalog.read("pipeline_runs"), catalog.read("pipeline_run_steps"), wanted["run_id"])
    totals = [F.coalesce(F.col("issue_totals")[s], F.lit(0).cast("bigint")).alias(s) for s in ("critical", "error", "warning", "info")]
    parts = profile.select("source_file_id", "row_count", *totals)
    return parts.join(run.select("source_file_id", "status", F.size("steps").alias("n_steps"), F.array_join("steps.step_name", ",").alias("steps")), "source_file_id")


@query
def a17_profile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = profile_catalog(spark, sf_dir)
    totals = reads.profiles_with_totals(catalog.latest_profiles(), catalog.latest_issues())
    return totals.select("source_file_id", "status", *[
        F.coalesce(F.try_element_at("issue_totals", F.lit(s)), F.lit(0).cast("bigint")).alias(s)
        for s in ("critical", "error", "warning", "info")
    ])


@query
def k3_latest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same ledgers: only the newer rows are shown, with their columns and issues."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    nothing = spark.createDataFrame([], "file_id STRING")
    profile = profiled(spark, sf_dir)
    for day, batch_id in ((1, "run-1"), (2, "run-2")):
        now = M.BATCH_TIME.replace(day=day)
        P.store_profile(catalog, P.stored_form(profile, nothing, batch_id, now, TABLE_CONFIG), batch_id, now)
    latest = catalog.latest_profiles()
    n_columns = catalog.latest_column_profiles().groupBy("profile_id").agg(F.count("*").alias("n_columns"))
    n_issues = catalog.latest_issues().groupBy("profile_id").agg(F.count("*").alias("n_issues"))
    n_runs = catalog.read("pipeline_runs").groupBy("source_file_id").agg(F.count("*").alias("n_runs"))
    return (
        latest.join(n_columns, "profile_id", "left").join(n_issues, "profile_id", "left").join(n_runs, "source_file_id", "left")
        .select("source_file_id", *[F.date_format(c, "yyyy-MM-dd").alias(n) for c, n in (("generated_at", "day"), ("created_at", "created"), ("updated_at", "updated"))], "row_count", "n_columns",
                F.coalesce("n_issues", F.lit(0).cast("bigint")).alias("n_issues"), "n_runs")
    )


def corpus_catalog(spark: SparkSession, sf_dir: str) -> tuple[Catalog, str, DataFrame]:
    """A catalogue of all ledger files, and a folder in which some of them are missing."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    files = I.ledger_files(spark, sf_dir)
    known = files.select(
        F.col("file_id").alias("source_file_id"),
        F.lit("bank").alias("source_system_code"),
        F.concat("file_key", F.lit(".csv")).alias("original_filename"),
        F.concat_ws("_", "file_id", F.concat("file_key", F.lit(".csv"))).alias("stored_filename"),
        F.lit("").alias("relative_path"),
        F.lit(".csv").alias("file_extension"),
        F.lit("text/csv").alias("mime_type"),
        F.col("length").alias("file_size_bytes"),
        F.col("file_id").alias("sha256_checksum"),
        F.lit("registered").alias("status"),
        F.lit(M.BATCH_TIME).alias("discovered_at"),
        F.lit(M.BATCH_TIME).alias("registered_at"),
    )
    catalog.append("source_files", known, "files")
    catalog.commit("files", M.BATCH_TIME)
    return catalog, M.corpus_folder(spark, sf_dir, ~F.col("file_key").endswith("3-0")), files


@query
def b3_profile_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real files, registered, read, parsed, profiled and stored; the stored profiles."""
    catalog, folder, _ = corpus_catalog(spark, sf_dir)
    P.profile_registered(catalog, folder, "profiles", M.BATCH_TIME)
    return catalog.latest_profiles().select(
        "source_file_id", "status", "encoding", "delimiter", "row_count", "column_count", "empty_row_count",
        "duplicate_row_count", "file_size_bytes", "total_null_count", "total_non_null_count", "total_numeric_columns",
        "total_date_columns", "total_text_columns",
        *texts("monetary_total", "opening_balance", "closing_balance", "calculated_closing_balance", "running_balance_valid"),
    )


@query
def b4_profile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and steps of a batch in which some files are missing."""
    catalog, folder, _ = corpus_catalog(spark, sf_dir)
    P.profile_registered(catalog, folder, "profiles", M.BATCH_TIME)
    runs = catalog.read("pipeline_runs").select("run_id", "source_file_id", F.col("status").alias("run_status"))
    steps = catalog.read("pipeline_run_steps").select("run_id", "step_order", "step_name", "status", "error_message")
    return runs.join(steps, "run_id").drop("run_id")


@query
def j3_unprofiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do after a batch: the files that were missing, and all under a new version."""
    files = I.ledger_files(spark, sf_dir).select(F.col("file_id").alias("source_file_id"), "file_key")
    profiles = files.filter(~F.col("file_key").endswith("3-0")).select("source_file_id", F.lit("1.0.0").alias("profile_version"))
    left = [reads.unprofiled(files, profiles, v).withColumn("version", F.lit(v)) for v in ("1.0.0", "2.0.0")]
    return left[0].unionByName(left[1])


@query
def st1_incremental_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files land in two waves, each with an empty one, the second repeating some of the first; each wave is taken in as a stream."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    folder, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "intake-checkpoint")
    systems = spark.createDataFrame([("bank", "Bank", "", "csv", True)], "code STRING, name STRING, description STRING, source_type STRING, is_active BOOLEAN")
    files = I.ledger_files(spark, sf_dir)
    config = RegistrationConfig(extensions=(".csv", ".txt"))
    for number, wave in enumerate((F.col("file_key") < "3", F.col("file_key") >= "2")):
        M.write_files(files.filter(wave), f"{folder}/wave={number}")
        # a writer that has no row leaves one file without a byte
        M.write_files(files.limit(0), f"{folder}/empty={number}")
        stream = landing_stream(spark, folder, config)
        start_intake(
            catalog, stream, checkpoint, systems, F.lit("bank"), F.lit("text/plain"), config, directory=folder
        ).awaitTermination()
    runs = catalog.read("pipeline_runs")
    return runs.groupBy("source_file_id", "status").agg(F.count("*").alias("n"))
