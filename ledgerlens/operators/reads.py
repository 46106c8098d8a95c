"""Filtered, sorted and paged reads of the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.operators.rollup import issue_totals

ISSUE_FILTERS = (
    "source_file_id",
    "profile_id",
    "severity",
    "issue_type",
    "issue_code",
    "status",
    "column_name",
)


def filter_issues(issues: DataFrame, **equal: str | None) -> DataFrame:
    """Conjunction of the given equalities; ``None`` means no condition."""
    unknown = set(equal) - set(ISSUE_FILTERS)
    if unknown:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    for name, value in equal.items():
        if value is not None:
            issues = issues.filter(F.col(name) == value)
    return issues


def page(
    df: DataFrame, order_by: list[Column], page: int = 1, page_size: int = 20, max_size: int = 100
) -> DataFrame:
    """One page, numbered from 1. ``order_by`` must end with a unique key."""
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= page_size <= max_size:
        raise ValueError(f"page_size must be between 1 and {max_size}")
    return df.orderBy(*order_by).offset((page - 1) * page_size).limit(page_size)


def total(df: DataFrame) -> DataFrame:
    """Row count of the whole listing a page is taken from."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def issue_page(issues: DataFrame, page_no: int = 1, page_size: int = 50) -> DataFrame:
    return page(issues, [F.desc("detected_at"), F.desc("issue_fingerprint")], page_no, page_size, 200)


def profile_page(profiles: DataFrame, source_file_id: str, page_no: int = 1, page_size: int = 20) -> DataFrame:
    of_file = profiles.filter(F.col("source_file_id") == source_file_id)
    return page(of_file, [F.desc("generated_at"), F.desc("run_id")], page_no, page_size, 100)


def column_page(columns: DataFrame, profile_id: str, page_no: int = 1, page_size: int = 100) -> DataFrame:
    return page(columns.filter(F.col("profile_id") == profile_id), [F.col("column_position")], page_no, page_size, 200)


def system_page(systems: DataFrame, page_no: int = 1, page_size: int = 20) -> DataFrame:
    return page(systems, [F.col("name"), F.col("code")], page_no, page_size, 100)


def file_page(files: DataFrame, page_no: int = 1, page_size: int = 20) -> DataFrame:
    return page(files, [F.desc("registered_at"), F.desc("source_file_id")], page_no, page_size, 100)


def run_page(runs: DataFrame, page_no: int = 1, page_size: int = 20) -> DataFrame:
    return page(runs, [F.desc("started_at"), F.desc("run_id")], page_no, page_size, 100)


def files_with_system(files: DataFrame, systems: DataFrame) -> DataFrame:
    """Files with the name of their source system."""
    return files.join(
        systems.select(F.col("code").alias("source_system_code"), F.col("name").alias("source_system_name")),
        "source_system_code",
    )


def runs_with_steps(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Runs with their steps nested in order. A run has at most nine steps."""
    kept = [c for c in steps.columns if c not in ("run_id", "step_order", "batch_id")]
    nested = steps.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("step_order", *kept))).alias("steps")
    )
    return runs.join(nested, "run_id", "left")


def unprofiled(files: DataFrame, profiles: DataFrame, version: str) -> DataFrame:
    """Files without a profile of the given version."""
    return files.join(profiles.filter(F.col("profile_version") == version), "source_file_id", "left_anti")


def profiles_with_totals(profiles: DataFrame, issues: DataFrame) -> DataFrame:
    """Profiles with their findings per severity."""
    empty = F.create_map().cast("map<string,bigint>")
    return profiles.join(issue_totals(issues, "profile_id"), "profile_id", "left").withColumn(
        "issue_totals", F.coalesce("issue_totals", empty)
    )


def profiles_with_files(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """Profiles with the name and the size of their files."""
    size = F.col("file_size_bytes").alias("registered_size_bytes")
    return profiles.join(files.select("source_file_id", "original_filename", size), "source_file_id")


def file_by_id(files: DataFrame, systems: DataFrame, source_file_id: str) -> DataFrame:
    """One file with its source system; no row if there is none."""
    return files_with_system(files.filter(F.col("source_file_id") == source_file_id), systems)


def run_by_id(runs: DataFrame, steps: DataFrame, run_id: str) -> DataFrame:
    """One run with its steps; no row if there is none."""
    own = F.col("run_id") == run_id
    return runs_with_steps(runs.filter(own), steps.filter(own))


def profile_by_id(profiles: DataFrame, issues: DataFrame, profile_id: str) -> DataFrame:
    """One profile with its findings per severity; no row if there is none."""
    own = F.col("profile_id") == profile_id
    return profiles_with_totals(profiles.filter(own), issues.filter(own))


def issue_by_id(issues: DataFrame, issue_fingerprint: str) -> DataFrame:
    """One finding; no row if there is none."""
    return issues.filter(F.col("issue_fingerprint") == issue_fingerprint)
