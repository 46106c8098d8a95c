"""Every registered query against its DuckDB restatement on the smallest given tables."""

import pytest
from pyspark.sql import functions as F

import entry_queries.catalogue
import entry_queries.inputs
import entry_queries.more_inputs
import entry_queries.oracles

import __spark_entry__ as entry_module
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
# the queries of the subpackage llm have tests of their own
QUERIES, ORACLES = entry_queries.catalogue.QUERIES, entry_queries.oracles.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_statistics_are_made_from_written_values(spark, monkeypatch):
    """Counting, parsing and the statistics of columns must not share a task, whose memory would grow with the parts of a shuffle."""
    columns, given = entry_queries.catalogue.C, []
    made = columns.column_statistics
    monkeypatch.setattr(columns, "column_statistics", lambda parsed: given.append(parsed) or made(parsed))
    entry_queries.catalogue.statistics(spark, SF_DIR)
    assert [("Aggregate" in p._jdf.queryExecution().optimizedPlan().toString()) for p in given] == [False]


def test_files_of_values_and_records_are_short(spark, monkeypatch):
    """A task reads a bounded number of files, so short ones bound what it sorts and counts."""
    monkeypatch.setattr(entry_queries.catalogue.C, "VALUE_ROWS", 50)
    monkeypatch.setattr(entry_queries.inputs, "RECORD_ROWS", 40)
    monkeypatch.setattr(entry_queries.inputs, "_staged", {})
    ledger = entry_queries.inputs.ledger(spark, SF_DIR)
    values = entry_queries.catalogue.C.written_values(entry_queries.catalogue.counts(spark, SF_DIR))
    for table, most in ((ledger, 40), (values, 50)):
        rows = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
        assert sum(rows) > most >= max(rows)


def test_files_are_moved_by_the_tasks_that_write_them(spark, monkeypatch, tmp_path):
    """One file a row, and every row in one; a job that moves them itself would move them one by one."""
    options = []
    writer = type(spark.range(1).write)
    made = writer.option
    monkeypatch.setattr(writer, "option", lambda self, key, value: options.append((key, value)) or made(self, key, value))
    rows = spark.createDataFrame([(b"a,b\n1,2\n",), (b"c\n",)], "content binary").coalesce(1)
    entry_queries.more_inputs.write_files(rows, str(tmp_path / "files"))
    assert ("mapreduce.fileoutputcommitter.algorithm.version", 2) in options
    assert sorted(p.read_text() for p in (tmp_path / "files").glob("part-*")) == ["a,b\n1,2\n", "c\n"]
