"""Held-out accuracy, and what is and is not learned from."""

import zlib

import numpy as np
import pyarrow as pa

from ledgerlens.llm import language_id as L

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    # labels of held-out documents are no input: they are wrong here
    spoiled = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    rows = L.identify(spoiled).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.97


def test_tables_equal_the_plain_network():
    chance = np.random.default_rng(1)
    windows = chance.integers(0, 256, (5, L.WINDOW)).astype(np.uint8)
    model = L.train(windows, np.array([0, 1, 0, 1, 1]), ["a", "b"])
    best = []
    for w in L.WIDTHS:
        span = L.WINDOW - w + 1
        best.append(sum(model.filters[w][k][windows[:, k : k + span]] for k in range(w)).max(axis=1))
    hidden = np.maximum(np.concatenate(best, axis=1) + model.bias, 0) @ model.weights + model.offset
    want = np.exp(hidden) / np.exp(hidden).sum(axis=1, keepdims=True)
    assert np.allclose(model.probabilities(windows), want, atol=1e-4)


def test_whole_texts_are_read():
    """Windows cover every byte, and a long text in stretches scores as its windows do."""
    texts = ["ab" * 1000, "", "x", "ü" * 300]
    data, offsets = L.buffer_of(pa.array(texts))
    windows, text, size = L.windows_of(data, offsets)
    for i, t in enumerate(texts):
        assert b"".join(bytes(w[:s]) for w, s in zip(windows[text == i], size[text == i], strict=True)) == t.encode()
    model = L.train(windows, np.arange(len(windows)) % 2, ["a", "b"])
    long = "abc äöü " * 200_000
    data, offsets = L.buffer_of(pa.array([long]))
    windows, _, size = L.windows_of(data, offsets)
    want = (model.probabilities(windows) * size[:, None]).sum(axis=0) / size.sum()
    assert np.allclose(L._scores(model, data, offsets)[0], want)


def test_odd_rows(documents):
    rows = [(i, "the cat and the dog are there " * (i + 3), "en") for i in range(40)]
    rows += [(100 + i, "der Hund und die Katze sind da " * (i + 3), "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 !!", "de"), (None, "der Hund und die Katze sind da", "de"), (203, "the cat and the dog are there", None), (203, "the cat and the dog are there", None)]
    rows += [(204, "und die Katze " * 60_000, None)]
    got = [(r.doc_id, r.lang_pred, r.score > 0.5) for r in L.identify(documents(rows, extra=True)).collect() if r.doc_id is None or r.doc_id >= 200]
    want = [(200, "und", False), (201, "und", False), (202, "und", False), (203, "en", True), (203, "en", True), (204, "de", True), (None, "de", True)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_nothing_to_learn(documents):
    assert L.identify(documents([])).count() == 0
    assert [tuple(r)[2:] for r in L.identify(documents([(1, "text", None)])).collect()] == [("und", 0.0)]
    assert [tuple(r)[2:] for r in L.identify(documents([(1, "text", "en")])).collect()] == [("en", 1.0)]
