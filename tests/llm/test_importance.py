"""Weights against plain counting, the sample against its definition, and held-out separation."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from ledgerlens.llm import importance as I
from ledgerlens.llm.words import PUNCTUATION, buffer_of, mix, shingles_of, words_of

LABELS = "doc_id bigint, quality int, toxic int"


def grams(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return words + list(zip(words, words[1:], strict=False))


def bucket(gram):
    text = gram if isinstance(gram, str) else " ".join(gram)
    data, offsets = buffer_of(pa.array([text]))
    words = words_of(data, offsets, PUNCTUATION)
    value = mix(words.hash) if isinstance(gram, str) else shingles_of(words, 2, short=False)[1]
    return int(value[0] % np.uint64(I.BUCKETS))


def test_weights_are_ratios_of_the_other_folds_models(spark, documents):
    chance = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [" ".join(chance.choice(vocabulary[: 3 + i % 4]) for _ in range(chance.randint(0, 12))) for i in range(40)]
    good = [i for i in range(40) if i % 3 == 0]
    docs = documents(texts)
    folds = {r.doc_id: r.f for r in docs.select("doc_id", I.fold_of(docs.doc_id).alias("f")).collect()}
    got = {r.doc_id: r.log_weight for r in I.weigh(docs, I.fit(docs, spark.createDataFrame([(i,) for i in good], "doc_id bigint"))).collect()}
    buckets = {g: bucket(g) for t in texts for g in grams(t)}
    for doc, text in enumerate(texts):
        raw, target = collections.Counter(), collections.Counter()
        for other, t in enumerate(texts):
            if folds[other] != folds[doc]:
                raw.update(buckets[g] for g in grams(t))
                target.update(buckets[g] for g in grams(t) if other in good)
        scale = sum(target.values()) / sum(raw.values())
        logs = [math.log((target[b] + I.SMOOTHING) / (raw[b] * scale + I.SMOOTHING)) for b in (buckets[g] for g in grams(text))]
        assert (got[doc] is None) if not logs else abs(got[doc] - I.PASSAGE_GRAMS * sum(logs) / len(logs)) < 1e-3


def test_gumbel_sample(spark):
    rows = [(i, float(i % 5)) for i in range(400)] + [(None, 1.0), (500, None), (7, 2.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, log_weight double").repartition(7)
    got = I.sample(df, 100).collect()
    order = sorted(got, key=lambda r: r.sample_rank)
    assert [r.sample_rank for r in order] == list(range(1, 404)) and [r.selected for r in order] == [True] * 100 + [False] * 303
    keys = [r.gumbel_key for r in order]
    assert keys[-1] is None and keys[:-1] == sorted(keys[:-1], reverse=True)
    assert sorted(map(str, got)) == sorted(map(str, I.sample(df.repartition(3), 100).collect()))
    # heavier documents are drawn more often, in proportion while few are drawn
    mean = np.mean([r.log_weight for r in order[:50]])
    assert mean > 3


def test_separates_what_labels_say(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    weight = {r.doc_id: r for r in I.resample(docs, labels).collect()}
    rows = labels.collect()
    good = [weight[r.doc_id] for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [weight[r.doc_id] for r in rows if r.toxic == 1]
    assert len(weight) == docs.count()
    assert np.mean([g.log_weight > t.log_weight for g, t in zip(good, toxic * 20, strict=False)]) > 0.65
    assert np.mean([g.selected for g in good]) > np.mean([t.selected for t in toxic]) + 0.15


def test_odd_rows(spark, documents):
    rows = [(1, "good words here", None), (2, None, None), (3, "", None), (4, "bad words " * 60_000, None), (4, "good", None), (None, "good words", None)]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, None), (None, 1, None), (9, None, 0)], LABELS).selectExpr("*", "'x' AS text")
    got = I.resample(documents(rows, extra=True), labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    assert {r.doc_id for r in got if r.log_weight is None} == {2, 3} and sum(r.selected for r in got) == round(6 * 3 / 4)
    nothing = spark.createDataFrame([], LABELS)
    assert [r.selected for r in I.resample(documents(rows), nothing).collect()] == [True] * 6
    assert I.resample(documents([]), nothing).count() == 0
