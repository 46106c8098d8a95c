"""Result tables: append-only Parquet, one folder per batch, and a commit record written last.

A batch is visible once it is committed; writing it again (a retried task, a replayed stream batch)
replaces its folder. Reruns of a profile are kept, and the views below show the newest of every key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ledgerlens.schemas import TABLES


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def append(self, table: str, df: DataFrame, batch_id: str) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[table])]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{table}/batch_id={batch_id}")

    def commit(self, batch_id: str, committed_at: datetime) -> None:
        record = self.spark.range(1).select(F.lit(committed_at).alias("committed_at"))
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch_id={batch_id}")

    def _scan(self, table: str, schema: str) -> DataFrame:
        full = f"{schema}, batch_id STRING"
        try:
            return self.spark.read.schema(full).parquet(f"{self.root}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def commits(self) -> DataFrame:
        return self._scan("commits", "committed_at TIMESTAMP").select("batch_id")

    def read(self, table: str) -> DataFrame:
        """Rows of committed batches."""
        rows = self._scan(table, TABLES[table])
        return rows.join(self.commits(), "batch_id", "left_semi")

    def latest_profiles(self) -> DataFrame:
        return latest_profiles(self.read("source_file_profiles"))

    def latest_profile_of_files(self) -> DataFrame:
        return latest_of_files(self.read("source_file_profiles"))

    def latest_column_profiles(self) -> DataFrame:
        return of_runs(self.read("source_file_column_profiles"), self.latest_profiles())

    def latest_issues(self) -> DataFrame:
        return of_runs(self.read("data_quality_issues"), self.latest_profiles())


def latest_profiles(profiles: DataFrame) -> DataFrame:
    """The newest row of every (file, version), with the times of its first and of its last run (created_at, updated_at).

    The rank limit also applies before the shuffle, and so do the least and greatest times.
    """
    key = ["source_file_id", "profile_version"]
    newest = Window.partitionBy(*key).orderBy(F.desc("generated_at"), F.desc("run_id"))
    latest = profiles.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
    times = profiles.groupBy(*key).agg(F.min("generated_at").alias("created_at"), F.max("generated_at").alias("updated_at"))
    return latest.join(times, key)


def latest_of_files(profiles: DataFrame) -> DataFrame:
    """The newest profile of every file, whatever its version."""
    newest = Window.partitionBy("source_file_id").orderBy(F.desc("generated_at"), F.desc("profile_version"), F.desc("run_id"))
    return profiles.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def of_runs(details: DataFrame, profiles: DataFrame) -> DataFrame:
    """Column profiles or issues that belong to the given profile rows."""
    return details.join(profiles.select("profile_id", "run_id"), ["profile_id", "run_id"], "left_semi")
