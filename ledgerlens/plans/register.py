"""Registration of a batch of landed files: checks, checksums, duplicates, catalogue rows and audit."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.config import RegistrationConfig
from ledgerlens.durable import materialize
from ledgerlens.operators.registration import MESSAGES, check_files, mark_duplicates
from ledgerlens.sources.catalog import Catalog
from ledgerlens.sources.corpus import EMPTY_FILE, listed_paths, read_corpus

RUN_TYPE = "source_file_upload"
STEP = "receive_and_register"


class Registration(NamedTuple):
    outcomes: DataFrame
    files: DataFrame
    runs: DataFrame
    steps: DataFrame


def run_id(run_type: str, batch_id: str, key: Column) -> Column:
    """Derived, not random: a recomputed task names the same run."""
    return F.sha2(F.concat_ws("|", F.lit(run_type), F.lit(batch_id), key), 256)


def read_landing(
    spark: SparkSession, directory: str, manifest: DataFrame, config: RegistrationConfig = RegistrationConfig()
) -> DataFrame:
    """Manifest rows (path, original_filename, mime_type, source_system_code, discovered_at) with size and checksum.

    Files above a limit are listed but never opened. The bytes are hashed in the scan and go no further. A file
    that has not arrived has neither size nor checksum; the source reads no empty file, so the listing tells them apart.
    """
    listing = read_corpus(spark, directory).select("path", "length")
    hashes = read_corpus(spark, directory, config.max_bytes).select("path", F.sha2("content", 256).alias("sha256_checksum"))
    arrived = listed_paths(spark, directory).withColumn("_arrived", F.lit(True))
    landed = manifest.join(listing, "path", "left").join(hashes, "path", "left").join(arrived, "path", "left")
    empty = F.col("length").isNull() & F.col("_arrived")
    return landed.withColumns(
        {
            "length": F.when(empty, F.lit(0).cast("bigint")).otherwise(F.col("length")),
            "sha256_checksum": F.when(empty, EMPTY_FILE).otherwise(F.col("sha256_checksum")),
        }
    ).drop("_arrived")


def landing_of(files: DataFrame, config: RegistrationConfig = RegistrationConfig()) -> DataFrame:
    """The same for a table that already holds the ``content``."""
    size = F.octet_length("content").cast("bigint")
    small = F.lit(True) if config.max_bytes is None else size <= config.max_bytes
    return files.withColumns({"length": size, "sha256_checksum": F.when(small, F.sha2("content", 256))}).drop("content")


def register_batch(
    landing: DataFrame,
    systems: DataFrame,
    registry: DataFrame,
    batch_id: str,
    now: datetime,
    config: RegistrationConfig = RegistrationConfig(),
) -> Registration:
    """Outcome, catalogue row and audit of every landed file.

    The bytes are hashed once, and the outcome is fixed in a table before the registry it depends on grows.
    """
    landing = materialize(landing, "landing")
    outcomes = mark_duplicates(check_files(landing, systems, config), registry).withColumn(
        "run_id", run_id(RUN_TYPE, batch_id, F.col("path"))
    )
    outcomes = materialize(outcomes, "outcomes")
    at = F.lit(now)
    done = F.col("outcome") != "failed"
    files = outcomes.filter(F.col("outcome") == "registered").select(
        F.col("sha256_checksum").alias("source_file_id"),
        "source_system_code",
        "original_filename",
        "stored_filename",
        "relative_path",
        "file_extension",
        F.col("normalized_mime_type").alias("mime_type"),
        F.col("length").alias("file_size_bytes"),
        "sha256_checksum",
        F.lit("registered").alias("status"),
        "discovered_at",
        at.alias("registered_at"),
    )
    common = [
        F.col("outcome").alias("status"),
        at.alias("started_at"),
        at.alias("completed_at"),
        F.col("error_message"),
    ]
    zero = F.lit(0).cast("bigint")
    runs = outcomes.select(
        "run_id",
        F.lit(RUN_TYPE).alias("run_type"),
        *common,
        F.when(done, F.col("sha256_checksum")).alias("source_file_id"),
        zero.alias("records_extracted"),
        zero.alias("records_accepted"),
        zero.alias("records_rejected"),
    )
    steps = outcomes.select(
        "run_id", F.lit(STEP).alias("step_name"), F.lit(1).alias("step_order"), *common, step_metadata().alias("metadata_json")
    )
    return Registration(outcomes, files, runs, steps)


def step_metadata() -> Column:
    """JSON of what is known of the file; fields that do not apply are left out."""
    registered, done = F.col("outcome") == "registered", F.col("outcome") != "failed"
    return F.to_json(
        F.struct(
            F.coalesce("original_filename", F.lit("")).alias("original_filename"),
            F.col("source_system_code"),
            F.when(registered, F.col("stored_filename")).alias("stored_filename"),
            F.when(done, F.col("sha256_checksum")).alias("sha256_checksum"),
            F.when(registered, F.col("length")).alias("file_size_bytes"),
        )
    )


def upload_responses(outcomes: DataFrame) -> DataFrame:
    """What a caller is told about every file."""
    return outcomes.select(
        "path",
        F.col("outcome").alias("status"),
        F.when(F.col("outcome") == "duplicate", "duplicate").otherwise(F.col("error_code")).alias("code"),
        F.when(F.col("outcome") == "duplicate", MESSAGES["duplicate"]).otherwise(F.col("error_message")).alias("message"),
        F.when(F.col("outcome") != "failed", F.col("sha256_checksum")).alias("source_file_id"),
        "run_id",
    )


def store_registration(catalog: Catalog, registration: Registration, batch_id: str, now: datetime) -> None:
    catalog.append("source_files", registration.files, batch_id)
    catalog.append("pipeline_runs", registration.runs, batch_id)
    catalog.append("pipeline_run_steps", registration.steps, batch_id)
    catalog.commit(batch_id, now)
