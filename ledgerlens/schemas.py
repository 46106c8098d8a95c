"""Schemas of the stored tables. Files are keyed by the SHA-256 of their bytes."""

ISSUE = (
    "file_id STRING, column_name STRING, row_number BIGINT, issue_code STRING, issue_type STRING, "
    "severity STRING, message STRING, observed_value STRING, expected_value STRING"
)

SOURCE_SYSTEMS = "code STRING, name STRING, description STRING, source_type STRING, is_active BOOLEAN"

SOURCE_FILES = (
    "source_file_id STRING, source_system_code STRING, original_filename STRING, stored_filename STRING, "
    "relative_path STRING, file_extension STRING, mime_type STRING, file_size_bytes BIGINT, "
    "sha256_checksum STRING, status STRING, discovered_at TIMESTAMP, registered_at TIMESTAMP"
)

PIPELINE_RUNS = (
    "run_id STRING, run_type STRING, status STRING, started_at TIMESTAMP, completed_at TIMESTAMP, "
    "source_file_id STRING, records_extracted BIGINT, records_accepted BIGINT, records_rejected BIGINT, "
    "error_message STRING"
)

PIPELINE_RUN_STEPS = (
    "run_id STRING, step_name STRING, step_order INT, status STRING, started_at TIMESTAMP, "
    "completed_at TIMESTAMP, metadata_json STRING, error_message STRING"
)

FILE_PROFILES = (
    "profile_id STRING, source_file_id STRING, run_id STRING, profile_version STRING, status STRING, "
    "encoding STRING, delimiter STRING, row_count BIGINT, column_count BIGINT, empty_row_count BIGINT, "
    "duplicate_row_count BIGINT, file_size_bytes BIGINT, date_range_start DATE, date_range_end DATE, "
    "total_null_count BIGINT, total_non_null_count BIGINT, total_numeric_columns BIGINT, "
    "total_date_columns BIGINT, total_text_columns BIGINT, total_boolean_columns BIGINT, "
    "monetary_total DECIMAL(24,6), debit_total DECIMAL(24,6), credit_total DECIMAL(24,6), "
    "opening_balance DECIMAL(24,6), closing_balance DECIMAL(24,6), "
    "calculated_closing_balance DECIMAL(24,6), running_balance_valid BOOLEAN, "
    "generated_at TIMESTAMP, profile_metadata_json STRING"
)

COLUMN_PROFILES = (
    "profile_id STRING, run_id STRING, column_name STRING, column_position INT, "
    "inferred_data_type STRING, original_data_type STRING, row_count BIGINT, null_count BIGINT, "
    "non_null_count BIGINT, null_percentage DECIMAL(7,4), unique_count BIGINT, "
    "duplicate_value_count BIGINT, minimum_value STRING, maximum_value STRING, "
    "mean_value DECIMAL(24,6), median_value DECIMAL(24,6), standard_deviation DECIMAL(24,6), "
    "minimum_length INT, maximum_length INT, average_length DECIMAL(12,4), earliest_date DATE, "
    "latest_date DATE, sample_values ARRAY<STRING>, detected_formats ARRAY<STRING>"
)

ISSUES = (
    "issue_fingerprint STRING, source_file_id STRING, profile_id STRING, run_id STRING, "
    "column_name STRING, row_number BIGINT, issue_code STRING, issue_type STRING, severity STRING, "
    "message STRING, observed_value STRING, expected_value STRING, status STRING, "
    "metadata_json STRING, detected_at TIMESTAMP, resolved_at TIMESTAMP"
)

TABLES = {
    "source_systems": SOURCE_SYSTEMS,
    "source_files": SOURCE_FILES,
    "pipeline_runs": PIPELINE_RUNS,
    "pipeline_run_steps": PIPELINE_RUN_STEPS,
    "source_file_profiles": FILE_PROFILES,
    "source_file_column_profiles": COLUMN_PROFILES,
    "data_quality_issues": ISSUES,
}
