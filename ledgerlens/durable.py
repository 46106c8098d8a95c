"""Intermediate results that must survive the loss of executors.

Both helpers write to the shared folder named by ``spark.checkpoint.dir``. Only where the session
names none (a bare local session) is a folder of our own chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: later branches prune columns and never recompute.

    With ``file_rows`` no file has more rows. Opening a file counts as 4 MB of the 128 MB that a task reads, so a task then reads 32 files at
    most, and a sort in it holds 32 times as many rows at most, however many there are in all.

    Shuffle files of the write go when it ends, not when the driver next collects garbage: what is read later has been written.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    writer = df.write.option("compression", "zstd")
    writer = writer.option("maxRecordsPerFile", file_rows) if file_rows else writer
    try:
        writer.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows keep the partition they were computed in."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
