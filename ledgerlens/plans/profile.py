"""Profiles of whole corpora and tables: one staged job, whatever the number of files or groups.

Every stage that more than one later stage reads is written once to the shared folder, so nothing is parsed
or counted twice and a lost executor costs one stage at most.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.config import BROADCAST_COLUMNS, RECORD_ROWS, ProfilingConfig
from ledgerlens.durable import materialize
from ledgerlens.operators import columns as col_ops, ledger as ledger_ops, rollup, rules
from ledgerlens.operators.reads import unprofiled
from ledgerlens.operators.shaping import data_records, header_cells, limit_rows, to_cells
from ledgerlens.plans.register import run_id
from ledgerlens.sources.catalog import Catalog
from ledgerlens.sources.corpus import (
    EMPTY_FILE,
    extract_headers,
    in_few_tasks,
    parse_files,
    parse_folder,
    parsed_files,
    raw_records,
    read_corpus,
    with_encoding,
)
from ledgerlens.sources.delimited import Parsed

RUN_TYPE = "csv_profile"
# The recorded steps of a profile run, in order.
STEPS = (
    "load_registered_file",
    "detect_encoding_and_delimiter",
    "inspect_schema",
    "calculate_file_statistics",
    "calculate_column_statistics",
    "run_data_quality_rules",
    "validate_running_balance",
    "persist_profile",
    "finalize_profile",
)
BALANCE_CODES = ("running_balance_not_verifiable", "invalid_running_balance", "unexpected_negative_balance")


class Profile(NamedTuple):
    files: DataFrame
    columns: DataFrame
    issues: DataFrame


def _profile(
    facts: DataFrame,
    raw: DataFrame,
    rows: DataFrame,
    headers: DataFrame,
    file_findings: list[DataFrame],
    config: ProfilingConfig,
) -> Profile:
    cells = to_cells(rows)
    parsed = col_ops.written_values(col_ops.value_counts(cells))
    columns = materialize(
        col_ops.column_profiles(parsed, config, headers=header_cells(headers)), "columns"
    )
    few_columns = rules.mostly_numeric(columns).limit(BROADCAST_COLUMNS + 1).count() <= BROADCAST_COLUMNS
    file_counts = materialize(rollup.file_counts(raw, rows), "file-counts")
    # block totals, balances and control totals all read the parsed amounts
    ledger = materialize(ledger_ops.movements(ledger_ops.ledger_view(rows)), "movements")
    followed = materialize(ledger_ops.followed(ledger, config), "followed")
    summary = materialize(ledger_ops.summary_of(followed), "balances")
    findings = rules.all_issues(
        *file_findings,
        rules.header_rules(headers),
        rules.concept_rules(headers),
        rules.shape_rules(raw),
        rules.count_rules(file_counts.join(headers.filter("usable").select("file_id"), "file_id", "left_semi"), config),
        rules.cell_rules(cells),
        rules.repeated_identifier_rules(cells),
        rules.numeric_rules(cells, columns, few_columns=few_columns),
        rules.column_rules(columns, config),
        rules.verifiability_rules(summary),
        rules.balance_rules(ledger_ops.balances_of(followed)),
    )
    issues = materialize(rules.dedupe_issues(rules.with_fingerprints(findings, config.version)), "issues")
    before_balance = (
        issues.filter(~F.col("issue_code").isin(*BALANCE_CODES)).groupBy("file_id").agg(F.count(F.lit(1)).alias("rule_issue_count"))
    )
    files = facts
    for part in (
        headers.select("file_id", "names", "concepts"),
        file_counts,
        rollup.rollup_files(columns),
        ledger_ops.control_totals(ledger),
        summary.drop("verifiable"),
        rollup.profile_status(issues),
        before_balance,
    ):
        files = files.join(part, "file_id", "left")
    zeros = ["row_count", "column_count", "empty_row_count", "duplicate_row_count", "total_null_count",
             "total_non_null_count", "total_numeric_columns", "total_date_columns", "total_text_columns",
             "total_boolean_columns", "rule_issue_count"]
    files = files.withColumns(
        {
            "status": F.coalesce("status", F.lit("completed")),
            "profile_metadata_json": profile_metadata(F.col("names"), F.col("concepts"), config),
            **{name: F.coalesce(name, F.lit(0).cast("bigint")) for name in zeros},
        }
    )
    return Profile(materialize(files, "files"), columns, issues)


def profile_metadata(names: Column, concepts: Column, config: ProfilingConfig = ProfilingConfig()) -> Column:
    """JSON with column names, identified columns (concept to name) and the tolerance."""
    names = F.coalesce(names, F.array().cast("array<string>"))
    pairs = F.filter(F.arrays_zip(concepts.alias("c"), names.alias("n")), lambda p: p["c"].isNotNull())
    identified = F.map_from_entries(F.array_sort(F.array_distinct(pairs)))
    return F.to_json(
        F.struct(
            names.alias("column_names"),
            F.coalesce(identified, F.create_map().cast("map<string,string>")).alias("identified_columns"),
            F.lit(float(config.balance_tolerance)).alias("running_balance_tolerance"),
        )
    )


def profile_files(files: DataFrame, config: ProfilingConfig = ProfilingConfig()) -> Profile:
    """Profiles files that are in the table (file_id, length, content)."""
    return profile_parsed(parse_files(with_encoding(files, config.encodings), config.max_rows), config)


def profile_parsed(parsed: Parsed, config: ProfilingConfig = ProfilingConfig()) -> Profile:
    """Profiles parsed files; ``files.error`` is set where parsing failed."""
    facts = parsed_files(parsed)
    raw = raw_records(parsed)
    return _profile(
        facts,
        raw,
        data_records(raw),
        materialize(extract_headers(raw), "headers"),
        [rules.file_class_rules(facts)],
        config,
    )


def profile_records(records: DataFrame, config: ProfilingConfig = ProfilingConfig()) -> Profile:
    """Profiles records of a table (see ``records_from_table``); groups may be of any size."""
    if config.max_rows is not None:
        records = limit_rows(records, config.max_rows)
    records = materialize(records, "records", RECORD_ROWS)
    headers = records.filter(F.col("row_no") == 2).select(
        "file_id", "names", "concepts", F.exists("names", lambda name: name != "").alias("usable")
    )
    unknown = {"length": "bigint", "encoding": "string", "delimiter": "string", "error": "string"}
    facts = headers.select("file_id", *[F.lit(None).cast(kind).alias(name) for name, kind in unknown.items()])
    # A table has no header record and no blank one, so its rows are also its records as written.
    return _profile(facts, records, records, headers, [], config)


class StoredProfile(NamedTuple):
    profiles: DataFrame
    columns: DataFrame
    issues: DataFrame
    runs: DataFrame
    steps: DataFrame


def stored_form(
    profile: Profile, missing: DataFrame, batch_id: str, now: datetime, config: ProfilingConfig = ProfilingConfig()
) -> StoredProfile:
    """The result tables of a profiled batch with their audit. ``missing``: file_id of files that are gone."""
    at = F.lit(now)
    version = F.lit(config.version)
    profile_id = F.sha2(F.concat_ws("|", "file_id", version), 256)
    run = run_id(RUN_TYPE, batch_id, F.col("file_id"))
    good = profile.files.filter(F.col("error").isNull()).select("file_id")
    profiles = profile.files.filter(F.col("error").isNull()).select(
        "*",
        profile_id.alias("profile_id"),
        F.col("file_id").alias("source_file_id"),
        run.alias("run_id"),
        version.alias("profile_version"),
        F.col("length").alias("file_size_bytes"),
        at.alias("generated_at"),
    )
    columns = profile.columns.join(good, "file_id", "left_semi").select(
        "*",
        profile_id.alias("profile_id"),
        run.alias("run_id"),
    )
    issues = profile.issues.join(good, "file_id", "left_semi").select(
        "*",
        F.col("file_id").alias("source_file_id"),
        profile_id.alias("profile_id"),
        run.alias("run_id"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("metadata_json"),
        at.alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    gone = missing.select(
        "file_id", F.lit("Registered source file is missing").alias("error"), F.lit(1).alias("failed_step")
    )
    outcomes = profile.files.withColumn("failed_step", F.when(F.col("error").isNotNull(), 2)).unionByName(
        gone, allowMissingColumns=True
    )
    runs, steps = profile_audit(outcomes.withColumn("profile_id", profile_id), batch_id, now)
    return StoredProfile(profiles, columns, issues, runs, steps)


def profile_audit(outcomes: DataFrame, batch_id: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """One run and nine steps per file. After a failed step the rest stays pending."""
    at, failed = F.lit(now), F.col("error").isNotNull()
    runs = outcomes.select(
        run_id(RUN_TYPE, batch_id, F.col("file_id")).alias("run_id"),
        F.lit(RUN_TYPE).alias("run_type"),
        F.when(failed, "failed").otherwise(F.col("status")).alias("status"),
        at.alias("started_at"),
        at.alias("completed_at"),
        F.col("file_id").alias("source_file_id"),
        F.when(failed, 0).otherwise(F.col("row_count")).cast("bigint").alias("records_extracted"),
        F.lit(0).cast("bigint").alias("records_accepted"),
        F.lit(0).cast("bigint").alias("records_rejected"),
        F.col("error").alias("error_message"),
    )
    keep_null = {"ignoreNullFields": "false"}
    metadata = [
        F.to_json(F.struct(F.col("length").alias("file_size_bytes"))),
        F.to_json(F.struct("encoding", "delimiter"), keep_null),
        F.to_json(F.struct(F.coalesce("names", F.array().cast("array<string>")).alias("columns"))),
        F.to_json(F.struct("row_count", "duplicate_row_count")),
        F.to_json(F.struct("column_count")),
        F.to_json(F.struct(F.col("rule_issue_count").alias("issue_count"))),
        F.to_json(F.struct("running_balance_valid"), keep_null),
        F.to_json(F.struct("profile_id")),
        F.to_json(F.struct("status")),
    ]
    # The nine steps are literals, so they multiply rows inside a task.
    steps = outcomes.select(
        "file_id",
        "error",
        "failed_step",
        F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), m.alias("meta")) for n, m in zip(STEPS, metadata)])).alias("i", "s"),
    )
    order = F.col("i") + 1
    status = (
        F.when(F.col("failed_step").isNull() | (order < F.col("failed_step")), "completed")
        .when(order == F.col("failed_step"), "failed")
        .otherwise("pending")
    )
    steps = steps.withColumn("_status", status).select(
        run_id(RUN_TYPE, batch_id, F.col("file_id")).alias("run_id"),
        F.col("s.name").alias("step_name"),
        order.cast("int").alias("step_order"),
        F.col("_status").alias("status"),
        at.alias("started_at"),
        F.when(F.col("_status") != "pending", at).alias("completed_at"),
        F.when(F.col("_status") == "completed", F.col("s.meta")).otherwise("{}").alias("metadata_json"),
        F.when(F.col("_status") == "failed", F.col("error")).alias("error_message"),
    )
    return runs, steps


def store_profile(catalog: Catalog, stored: StoredProfile, batch_id: str, now: datetime) -> None:
    catalog.append("source_file_profiles", stored.profiles, batch_id)
    catalog.append("source_file_column_profiles", stored.columns, batch_id)
    catalog.append("data_quality_issues", stored.issues, batch_id)
    catalog.append("pipeline_runs", stored.runs, batch_id)
    catalog.append("pipeline_run_steps", stored.steps, batch_id)
    catalog.commit(batch_id, now)


def profile_registered(
    catalog: Catalog,
    directory: str,
    batch_id: str,
    now: datetime,
    *,
    only_unprofiled: bool = True,
    source_file_ids: DataFrame | None = None,
    config: ProfilingConfig = ProfilingConfig(),
) -> StoredProfile:
    """Profiles registered files whose bytes are below ``directory``, all in one job, and stores the results."""
    registered = catalog.read("source_files")
    if source_file_ids is not None:
        registered = registered.join(source_file_ids, "source_file_id", "left_semi")
    if only_unprofiled:
        registered = unprofiled(registered, catalog.read("source_file_profiles"), config.version)
    wanted = materialize(registered.select(F.col("source_file_id").alias("file_id")), "wanted")
    # Files are known by their checksum; of equal copies one is profiled. No name is kept for the table: it holds the whole listing.
    found = materialize(
        in_few_tasks(read_corpus(catalog.spark, directory))
        .groupBy(F.sha2("content", 256).alias("file_id"), "length")
        .agg(F.min("path").alias("path")),
        "found",
    )
    chosen = materialize(found.join(wanted, "file_id", "left_semi"), "chosen")
    empty = wanted.filter(F.col("file_id") == EMPTY_FILE).select(
        F.lit(None).cast("string").alias("path"), "file_id", F.lit(0).cast("bigint").alias("length")
    )
    files = chosen.select("path", "file_id", "length").unionByName(empty)
    missing = wanted.filter(F.col("file_id") != EMPTY_FILE).join(found, "file_id", "left_anti")
    parsed = parse_folder(catalog.spark, directory, files, config.encodings, config.max_rows)
    stored = stored_form(profile_parsed(parsed, config), missing, batch_id, now, config)
    store_profile(catalog, stored, batch_id, now)
    return stored
