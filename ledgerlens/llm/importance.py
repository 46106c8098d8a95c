"""Quality by importance resampling: how much likelier a text is under a model of target text than under one of raw text.

Both models are smoothed frequencies of hashed words and word pairs. The documents are dealt into two folds by their
ids, and a document is weighed by the models of the other fold, so that no document vouches for itself. A
document's log weight is that of a passage of a standard length with its mean, and Gumbel noise on the log weights turns the k largest into a
sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.durable import materialize
from ledgerlens.llm.words import PUNCTUATION, buffer_of, mix, shingles_of, slices, words_of
from ledgerlens.operators.ordered import number_rows

#: Buckets that words and pairs are hashed into; what the driver and every task hold is bounded by them.
BUCKETS = 1 << 18
#: What is added to the count of every bucket in either model, raw counts being scaled to the size of the target.
SMOOTHING = 1.0
#: Labelled documents that the target model is made from, chosen by the hash of their ids.
TARGET_DOCUMENTS = 200_000
#: N-grams of a passage of standard length.
PASSAGE_GRAMS = 256
SEED = 17


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(2)).cast("int")


def _buckets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts with (text, bucket) of all their words and pairs of words."""
    data, offsets = buffer_of(batch.column(column))
    for low, high in slices(offsets):
        words = words_of(data, offsets[low : high + 1], PUNCTUATION)
        text, pair, _ = shingles_of(words, 2, short=False)
        found = np.concatenate([mix(words.hash), pair]) % np.uint64(BUCKETS)
        yield low, high, np.concatenate([words.text, text]), found.astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, target, text): how often each bucket occurs in this partition, in all texts and in those of the target."""
    raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        fold, wanted = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for low, _, text, bucket in _buckets(batch, 2):
            at = fold[low + text] * BUCKETS + bucket
            raw += np.bincount(at, minlength=2 * BUCKETS)
            target += np.bincount(at[wanted[low + text].astype(bool)], minlength=2 * BUCKETS)
    there = np.flatnonzero(raw)
    for at in range(0, len(there), 1 << 16):
        some = there[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


@dataclass
class Ratio:
    """``log_ratio[f]``: for every bucket the log of target over raw, from the documents of the other fold."""

    log_ratio: np.ndarray


def fit(docs: DataFrame, targets: DataFrame, documents: int = TARGET_DOCUMENTS) -> Ratio:
    """Models of the texts whose id is in ``targets`` (doc_id), and of all texts. Without a target, all ratios are one."""
    ids = targets.where("doc_id IS NOT NULL").select("doc_id").distinct()
    share = documents / max(1, ids.count())
    drawn = ids.where(F.xxhash64("doc_id", F.lit(SEED + 1)) / F.lit(2.0**64) + 0.5 < share) if share < 1 else ids
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(drawn.withColumn("wanted", F.lit(True))), "doc_id", "left")
    rows = texts.select(fold_of(F.col("doc_id")).alias("fold"), F.coalesce("wanted", F.lit(False)).alias("wanted"), "text")
    counts = rows.mapInArrow(_counts, "bucket bigint, raw bigint, target bigint")
    counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros((2, 2 * BUCKETS))
    at = counts.column("bucket").to_numpy()
    raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    raw, target = raw.reshape(2, BUCKETS)[::-1], target.reshape(2, BUCKETS)[::-1]
    expected = raw * (target.sum(axis=1) / np.maximum(raw.sum(axis=1), 1))[:, None]
    return Ratio(np.log((target + SMOOTHING) / (expected + SMOOTHING)).astype(np.float32))


def _weights(batches: Iterator[pa.RecordBatch], ratio: Ratio) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fold = batch.column(1).to_numpy()
        total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for low, high, text, bucket in _buckets(batch, 2):
            total[low:high] = np.bincount(text, ratio.log_ratio[fold[low + text], bucket], high - low)
            n[low:high] = np.bincount(text, minlength=high - low)
        weight = pa.array(PASSAGE_GRAMS * total / np.maximum(n, 1), mask=n == 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), weight], names=["doc_id", "log_weight"])


def weigh(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """(doc_id, log_weight) of every whole text; null where it has no words."""
    rows = docs.select(F.col("doc_id").cast("bigint"), fold_of(F.col("doc_id")).alias("fold"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_weights, ratio=ratio), "doc_id bigint, log_weight double")


def sample(weighed: DataFrame, rows: int, seed: int = SEED) -> DataFrame:
    """Adds gumbel_key, sample_rank (from 1) and selected (rank up to ``rows``); texts without weight come last.

    The noise goes with the id, so equal runs draw equal samples. Equal keys are ranked by id.
    """
    uniform = (F.xxhash64("doc_id", F.lit(seed)) / F.lit(2.0**64)) + 0.5
    noise = -F.log(-F.log(F.least(F.greatest(uniform, F.lit(1e-300)), F.lit(1 - 1e-16))))
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") + noise)
    # ranks by parts of the range of keys, so that no task sees all rows
    keyed = keyed.withColumns({"_order": F.coalesce(-F.col("gumbel_key"), F.lit(float("inf"))), "_id": F.coalesce("doc_id", F.lit(2**63 - 1))})
    ranked = number_rows(keyed, [], ["_order", "_id"], "sample_rank").drop("_order", "_id")
    return ranked.withColumn("selected", F.col("sample_rank") <= rows)


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, sample_rank, selected) of every row of documents.

    The target is what ``labels`` (doc_id, quality, toxic) calls good and not toxic. As many documents are drawn as the share of the
    target among the labelled ones says; without labels, all. A null quality is no label, a null toxic is 0.
    """
    known = labels.where("quality IS NOT NULL").select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    targets = known.where("good").select("doc_id")
    good, of = known.agg(F.count_if("good"), F.count("*")).first()
    weighed = materialize(weigh(docs, fit(docs, targets)), "weights")
    rows = round(weighed.count() * (good / of if of else 1))
    return sample(weighed, rows)
