"""Edited texts and neighbours against plain Python; fingerprints by what they must tell apart."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import imatch

SF_DIR = "/root/testdata/sf0.001"


def edited(texts):
    """{doc_id: (edited text, next id)} for distinct ids."""
    ids = sorted(texts, reverse=True)
    out = {}
    for i, doc in enumerate(ids):
        after, text = ids[(i + 1) % len(ids)], texts[doc] or ""
        k = len(text) // 3
        out[doc] = (text[: len(text) - k] + (texts[after] or "")[:k], after)
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    want = edited(texts)
    assert got.keys() == texts.keys()
    for doc, r in got.items():
        assert r.n_chars == len(texts[doc]) and r.edited_sha256 == hashlib.sha256(want[doc][0].encode()).hexdigest()
        size = imatch.FAMILIES + 1
        parts = [r.fingerprint[16 * i : 16 * i + 16] for i in range(size)]
        theirs = [got[want[doc][1]].fingerprint[16 * i : 16 * i + 16] for i in range(size)]
        other = [r.edited_fingerprint[16 * i : 16 * i + 16] for i in range(size)]
        assert r.near_next == sum(a == b for a, b in zip(parts, theirs, strict=True)) / size
        assert r.near_edited == sum(a == b for a, b in zip(parts, other, strict=True)) / size
    by_text = {}
    for doc, r in got.items():
        assert by_text.setdefault(texts[doc], r.fingerprint) == r.fingerprint
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) / len(long) > 0.95


def test_lexicon_is_the_band(spark):
    chance = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(w.upper() + "," for i, w in enumerate(words) if chance.random() < i / 200) for _ in range(300)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    held = {w: sum(w in (t or "").lower().replace(",", "").split() for t in texts) for w in words}
    want = [w for w, n in held.items() if 0.2 * 301 <= n <= 0.5 * 301]
    hashes = spark.createDataFrame([(w,) for w in want], "w string").select(F.xxhash64("w").alias("h"))
    assert imatch.lexicon(df, 0.2, 0.5) == sorted(r.h for r in hashes.collect())


def test_every_term_of_the_band_counts(spark, documents):
    """Long texts make a large lexicon, and none of its terms is left out."""
    words = [f"w{i}" for i in range(130_000)]
    long = " ".join(words)
    texts = spark.createDataFrame([(long,), (long,), ("other",)], "text string")
    chosen = imatch.lexicon(texts, 0.5, 0.7)
    assert len(chosen) == len(words)
    # texts that differ in one such term, whichever, have other fingerprints
    pair = documents([f"common {words[0]}", f"common {words[-1]}", "common"]).withColumn("text", F.col("text").cast("string"))
    got = [r.own for r in imatch.fingerprinted(pair, "text", "own", chosen).collect()]
    assert got[0][0] != got[1][0] != got[2][0] != got[0][0]


@pytest.mark.parametrize("count", [1, 2, 57])
def test_next_ids(spark, count):
    ids = random.Random(count).sample(range(-1000, 1000), count)
    df = spark.createDataFrame([(i,) for i in [*ids, *ids[:2], None]], "doc_id bigint").repartition(5)
    got = {r.doc_id: r.next_id for r in imatch.next_ids(df).collect()}
    assert got == {i: n for i, (_, n) in edited(dict.fromkeys(ids, "")).items()}


def test_order_and_repetition_of_terms_do_not_count(documents):
    texts = ["alpha beta gamma", "GAMMA beta, beta! alpha", "alpha beta delta", "", None, "?!"]
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(documents(texts)).collect()}
    assert got[0] == got[1] != got[2] and got[3] == got[4] == got[5] != got[0]


def test_odd_rows(documents):
    long = "word " * 60_000 + "end"
    rows = [(5, "é one two three", None), (5, "é one two three", None), (4, None, None), (3, long, None), (2, "", None), (2, "abc def", None), (None, "one two three", None)]
    got = imatch.fingerprints(documents(rows, extra=True)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t, _ in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[5, 15].edited_sha256 == sha("é one two ") and by[4, 0].edited_sha256 == sha("")
    k = len(long) // 3
    assert by[3, len(long)].edited_sha256 == sha(long[: len(long) - k])  # the smallest text of id 2 is empty
    assert by[2, 7].edited_sha256 == sha("abc d" + "é ") and by[None, 13].edited_sha256 == sha("one two t")
    assert by[None, 13].near_next == 0
    assert imatch.fingerprints(documents([])).count() == 0


def test_no_python_on_the_executors(spark):
    plan = imatch.fingerprints(spark.read.parquet(f"{SF_DIR}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
