"""Columns of the input, whatever their names and types, come through the stages of the pipeline."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, language_id, ngram_join, secret_scan

TEXTS = ["the first text of all of them", "der zweite Text von allen ist hier", "token = abcdefghijklmnop", None, "the first text of all of them"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, "en" if i % 2 == 0 else "de", "s", len(t or "")) for i, t in enumerate(TEXTS)] * 2 + [(None, "no id is here", "en", "s", 13)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    odd = {"_new": "x", "_NEW_": "x", "_both": "y", "_language": "z", "IDS": "i", "n_tokens": "n", "exact": "e", "row": "r", "component_id": "c"}
    df = df.withColumns({name: F.lit(v) for name, v in odd.items()})
    return df.withColumns({"tags": F.create_map(F.lit("k"), F.col("doc_id")), "blob": F.lit(b"\x00\xff"), "nested": F.struct(F.create_map(F.lit(1), F.lit(2)).alias("m"))})


def stays(df, names):
    for row in df.collect():
        for name in names:
            assert row[name] == {"_new": "x", "_NEW_": "x", "_both": "y", "_language": "z", "row": "r", "component_id": "c"}[name]
        assert row["tags"] == {"k": row["doc_id"]} and row["nested"]["m"] == {1: 2} and bytes(row["blob"]) == b"\x00\xff"


def test_secrets(rows):
    found = secret_scan.without_secrets(rows)
    assert found.columns == rows.columns and found.count() == rows.count()
    stays(found, ["_new", "_NEW_", "_both", "_language", "row"])
    assert {r.text for r in found.where("doc_id = 2").collect()} == {"[assign]"}


def test_ids(rows):
    vocabulary = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    found = bpe.encoded(rows, vocabulary)
    stays(found, ["_new", "_both", "_language", "row"])
    assert all(r.exact and r.n_tokens == len(r.ids) for r in found.collect()) and "IDS" not in found.columns


def test_language(rows):
    found = language_id.identified(rows, 0.0)
    assert found.columns == rows.columns
    stays(found, ["_new", "_both", "_language", "row"])


def test_near_copies(rows):
    found = ngram_join.keep_one_of_each(rows, 5, 80)
    assert found.columns == rows.columns
    stays(found, ["_new", "_both", "_language", "row", "component_id"])
    assert sorted(r.doc_id for r in found.where("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3]
