"""Block-wise operators against plain windows; results must not depend on how rows are spread."""

from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from ledgerlens.config import ProfilingConfig
from ledgerlens.operators import columns as C, ledger as L, ordered, rules, shaping
from ledgerlens.sources.tables import records_from_table


@pytest.fixture(scope="module")
def rows(spark):
    """Group g0 holds most rows."""
    return spark.range(3000).select(
        F.concat(F.lit("g"), F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).cast("string")).alias("g"),
        (F.col("id") * 7919 % 3001).alias("k"),
        ((F.col("id") * 31 % 997) - 400).alias("v"),
    )


def test_number_rows(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ours = ordered.number_rows(rows, ["g"], ["k"], first=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("g").orderBy("k")) + 1)
    assert ours.select("g", "k", "row_no").exceptAll(plain.select("g", "k", "row_no")).count() == 0
    assert ours.count() == plain.count()


def test_running_sum_in_blocks(rows):
    numbered = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("g").orderBy("k")) + 1)
    upto = Window.partitionBy("g").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    plain = numbered.select("g", "row_no", F.sum("v").over(upto).alias("s"))
    for block in (1, 37, 100_000):
        ours = ordered.running_sum(numbered, ["g"], "row_no", F.col("v"), "s", block).select("g", "row_no", "s")
        assert ours.exceptAll(plain).count() == 0 and ours.count() == 3000


def test_medians_agree(spark, rows):
    numbers = rows.groupBy(F.col("g").alias("file_id"), F.lit(0).alias("position"), F.col("v").cast("decimal(28,10)").alias("number")).agg(F.count("*").alias("cnt"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = {r.file_id: r.median_value for r in C.medians(numbers).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    exact = {r.g: Decimal(str(r.m)) for r in rows.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("m")).collect()}
    assert split == exact


@pytest.fixture(scope="module")
def ledger_records(rows):
    numbered = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("g").orderBy("k")) + 1)
    balance = F.sum("v").over(Window.partitionBy("g").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0))
    df = numbered.withColumn("balance", balance + F.when(F.col("k") % 101 == 0, 5).otherwise(0)).select(
        "g",
        "row_no",
        F.when(F.col("k") % 3 == 0, "same").otherwise(F.col("k").cast("string")).alias("id"),
        F.col("v").cast("string").alias("amount"),
        F.concat(F.col("balance").cast("string"), F.when(F.col("k") % 7 == 0, ".500").otherwise("")).alias("balance"),
    )
    return records_from_table(df, "g", ["id", "amount", "balance"], row_no="row_no")


def test_running_balance_does_not_depend_on_blocks(ledger_records):
    view = L.ledger_view(ledger_records)
    config = ProfilingConfig(balance_tolerance=Decimal("0.6"))
    results = []
    for block in (11, 100_000):
        running = sorted(map(tuple, L.running_balance(view, config, block).collect()))
        summary = sorted(map(tuple, L.balance_summary(view, config, block).collect()))
        results.append((running, summary))
    assert results[0] == results[1]
    assert len(results[0][0]) == 3000


def test_repeated_identifiers_do_not_depend_on_blocks(ledger_records):
    cells = shaping.to_cells(ledger_records)
    found = [sorted(map(repr, rules.repeated_identifier_rules(cells, b).collect())) for b in (5, 100_000)]
    assert found[0] == found[1]
    assert len(found[0]) == ledger_records.filter("fields[0] = 'same'").count()


def test_profile_adds_up_and_ignores_partitioning(ledger_records):
    cells = shaping.to_cells(ledger_records)
    counts = C.value_counts(cells)
    assert counts.agg(F.sum("cnt")).first()[0] == 3 * 3000
    stats = [
        sorted(map(repr, C.column_profiles(C.value_counts(cells.repartition(n))).collect())) for n in (1, 13)
    ]
    assert stats[0] == stats[1]
    totals = C.column_statistics(C.parsed_values(counts))
    assert totals.filter("null_count + non_null_count <> row_count").count() == 0


def test_numeric_outliers_do_not_depend_on_the_join(rows):
    numbered = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("g").orderBy("k")) + 1)
    df = numbered.select(
        "g", "row_no", F.when(F.col("k") % 11 == 0, "x").otherwise(F.col("v").cast("string")).alias("n"), F.lit("text").alias("t")
    )
    cells = shaping.to_cells(records_from_table(df, "g", ["n", "t"], row_no="row_no"))
    columns = C.column_statistics(C.parsed_values(C.value_counts(cells)))
    found = [
        sorted(map(repr, rules.numeric_rules(cells, columns, *options).collect()))
        for options in ((7, False), (100_000, False), (None, True))
    ]
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == df.filter("n = 'x'").count()


def test_limit_rows_keeps_blank_records_up_to_the_last_row(spark):
    records = spark.createDataFrame(
        [("f", 1, None), ("f", 2, 2), ("f", 3, None), ("f", 4, 3), ("f", 5, None), ("f", 6, 4), ("g", 1, None), ("g", 2, None)],
        "file_id STRING, record_no BIGINT, row_no BIGINT",
    )
    kept = lambda n: sorted((r.file_id, r.record_no) for r in shaping.limit_rows(records, n).collect())
    assert kept(2) == [("f", 1), ("f", 2), ("f", 3), ("f", 4), ("g", 1), ("g", 2)]
    assert len(kept(3)) == len(kept(9)) == 8


def test_materialized_rows_are_packed(spark):
    """What is written to the shared folder takes a good deal less than the default of the session."""
    import glob

    from ledgerlens.durable import materialize

    rows = spark.range(20_000).selectExpr("id", "concat('T', id * 7919 % 20011) AS value", "cast(id * 37 % 90001 / 100 AS string) AS amount")
    found = materialize(rows, "packed")
    assert found.count() == 20_000 and found.subtract(rows).isEmpty()
    assert glob.glob(found.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "/*.zstd.parquet")


def test_materializing_leaves_no_shuffle_files(spark):
    """They go at the end of the write, not at some collection of garbage, and the session's setting is as before."""
    import time

    from ledgerlens.durable import CLEANUP, materialize

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for f in blocks.getAllFiles().mkString("|").split("|") if (name := f.rpartition("/")[2]).startswith("shuffle_")}
    before = files()
    found = materialize(spark.range(1000).groupBy((F.col("id") % 77).alias("k")).count(), "counted")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert found.count() == 77 and spark.conf.get(CLEANUP, "false") == "false"
