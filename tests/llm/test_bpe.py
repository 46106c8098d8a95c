"""Ids against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from ledgerlens.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
VOCABULARY = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encoded(texts):
    ids, counts = bpe._Memory(VOCABULARY).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdeinst 's'll \n\t\x0b\x1c\x85\xa0.,12éßñ日本👩‍'"), max_size=60), min_size=1, max_size=5))
def test_ids_equal_tiktoken(texts):
    assert encoded(texts) == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_long_words():
    chance = random.Random(5)
    texts = ["".join(chance.choice("aeinstqz") for _ in range(n)) for n in (1, 2, 255, 256, 257, 300, 5000)]
    texts += ["x" * 100_000, "ab" * 3000, "=" * 999, " " * 700, "\n" * 700, "", "é" * 400]
    assert encoded(texts) == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_both_ways_of_folding():
    chance = random.Random(6)
    for _ in range(300):
        word = "".join(chance.choice("aeiéñßnst") for _ in range(chance.randint(2, 40))).encode()
        assert VOCABULARY.fold_long(word).tolist() == VOCABULARY.fold([word])[0].tolist()


def test_higher_order_functions_give_the_same_ids(spark):
    words = ["", "a", "the", " thatnenon", "Straße", "日本語", "zzzzzzzz", "\n\n", " 12345", "'ll"] + [None]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_words(F.col("w"), RANKS).alias("ids"))
    want = {w: None if w is None else VOCABULARY.fold([w.encode()])[0].tolist() for w in words}
    assert {r.w: r.ids for r in df.collect()} == want


def test_memory_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    memory = bpe._Memory(VOCABULARY)
    for text in ("the cat and the dog and more words", "other words here", "the cat") * 3:
        assert memory.encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)


def test_unknown_ids():
    for ids in ([-1], [50_256], [70_000], [None]):
        with pytest.raises(ValueError):
            VOCABULARY.pieces(pa.array(ids, pa.int32()))


def test_query_and_odd_rows(spark, documents, tmp_path):
    texts = ["Straße 's  l'eau\n\n 日本語 " * 3, None, "", "x" * 300_000 + " end", "a b"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(4, "a b", None), (None, "a b", None)]
    documents(rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_byte_bpe"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id if r.doc_id is not None else 4] or ""
        ids = TIKTOKEN.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_null_lists_and_no_rows(spark):
    rows = spark.createDataFrame([([50, 60],), (None,), ([],)], "ids array<int>")
    got = [r.b for r in rows.select(bpe.decode("ids", VOCABULARY).alias("b")).collect()]
    assert got == [bytearray(TIKTOKEN.decode_bytes([50, 60])), None, bytearray()]
    assert rows.where("false").select(bpe.decode("ids", VOCABULARY)).count() == 0
