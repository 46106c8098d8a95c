"""Finds benchmark passages in training documents: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into passages. How many documents hold each n-gram of a passage is counted over all documents, and in every few
neighbouring n-grams of a passage the rarest that occurs at all becomes a seed: a passage keeps seeds all along even where it has been copied into very
many documents, and common phrases stay out. Where a seed occurs in a document, the words around it are
aligned with the passage; the score is the best local alignment over that of a verbatim copy, so that edited and
paraphrased copies score in proportion to what is left.

The items are the stated query set: they are taken in blocks of bounded size, each block is one pass over the documents, and
no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.words import PUNCTUATION, buffer_of, distinct, shingles_of, slices, tidied, words_of

SEED_WORDS = 3
#: Neighbouring n-grams of which the rarest becomes a seed.
SEED_EVERY = 2
#: Longer items are cut into passages of so many words that overlap by half; shorter items are no evidence.
PASSAGE_WORDS, LEAST_WORDS = 128, 5
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Bytes of items in a block, which every task holds; two passes over the documents for each block.
BLOCK_BYTES = 16 << 20
#: Cells aligned at a time.
CELLS = 1 << 20
FOUND = "array<struct<item_id bigint, score double, first_char int, end_char int>>"


@dataclass
class Passages:
    """Passages of a block of items; ``words`` holds the words of all, from ``begin`` to the next."""

    item: list[int | None]
    begin: np.ndarray
    words: np.ndarray
    gram: np.ndarray  # all n-grams: hash, passage, place
    passage: np.ndarray
    place: np.ndarray


@dataclass
class Seeds:
    passages: Passages
    gram: np.ndarray  # sorted, distinct
    first: np.ndarray  # where the places of a gram begin in ``passage`` and ``place``
    count: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray  # by the low 16 bits of a gram


def passages_of(items: list[tuple[int | None, str]], size: int = SEED_WORDS) -> Passages:
    data, offsets = buffer_of(pa.array([text for _, text in items], pa.large_string()))
    words = words_of(data, offsets, PUNCTUATION)
    counts = np.bincount(words.text, minlength=len(items))
    begins = np.cumsum(counts) - counts
    item, parts = [], []
    for i, n in enumerate(counts):
        starts = range(0, max(1, n - PASSAGE_WORDS // 2), PASSAGE_WORDS // 2) if n >= max(LEAST_WORDS, size) else []
        for start in starts:
            item.append(items[i][0])
            parts.append(words.hash[begins[i] + start : begins[i] + min(n, start + PASSAGE_WORDS)])
    begin = np.cumsum([0, *map(len, parts)])
    joined = np.concatenate([*parts, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(parts)), np.diff(begin))
    words = type(words)(len(parts), owner, begin[:0], begin[:0], joined)
    passage, gram, at = shingles_of(words, size, short=False)
    return Passages(item, begin, joined, gram, passage, at - begin[passage])


def seeds_of(passages: Passages, frequency: dict[int, int], every: int = SEED_EVERY) -> Seeds:
    """In every run of ``every`` n-grams of a passage the one in the fewest documents, the first of equals.

    N-grams that no document holds find nothing and take no other's place.
    """
    never = np.iinfo(np.int64).max
    rank = np.array([frequency.get(g, 0) or never for g in passages.gram.view(np.int64).tolist()], np.int64)
    keep = np.zeros(len(rank), bool)
    begins = np.searchsorted(passages.passage, np.arange(len(passages.item) + 1))
    for low, high in zip(begins[:-1], begins[1:], strict=True):
        for at in range(low, max(low + 1, high - every + 1)):
            keep[at + int(rank[at : min(at + every, high)].argmin())] = True
    keep &= rank < never
    order = np.flatnonzero(keep)[np.argsort(passages.gram[keep], kind="stable")]
    gram, first, count = np.unique(passages.gram[order], return_index=True, return_counts=True)
    bitmap = np.zeros(65536, bool)
    bitmap[gram & np.uint64(65535)] = True
    return Seeds(passages, gram, first, count, passages.passage[order], passages.place[order], bitmap)


def _lookup(gram: np.ndarray, bitmap: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in ``gram`` (sorted), and where."""
    near = np.flatnonzero(bitmap[(wanted & np.uint64(65535)).astype(np.int64)])
    if not len(gram):
        return near[:0], near[:0]
    at = np.minimum(np.searchsorted(gram, wanted[near]), len(gram) - 1)
    same = gram[at] == wanted[near]
    return near[same], at[same]


def _document_counts(batches: Iterator[pa.RecordBatch], gram: np.ndarray, bitmap: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """How many texts of this partition hold each n-gram."""
    total = np.zeros(len(gram), np.int64)
    for batch in batches:
        data, offsets = buffer_of(batch.column(0))
        for low, high in slices(offsets):
            text, shingle, _ = shingles_of(words_of(data, offsets[low : high + 1], PUNCTUATION), size, short=False)
            near, at = _lookup(gram, bitmap, shingle)
            np.add.at(total, distinct(text[near], at)[1], 1)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(gram[there].view(np.int64)), pa.array(total[there])], names=["gram", "n"])


def align(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of word sequences, row against row: score, and the last place of each sequence in it.

    ``one`` and ``two`` are (pairs, words); 0 fills ``one`` and 1 fills ``two``, and neither matches anything.
    """
    pairs, n = two.shape
    slope = -GAP * np.arange(n, dtype=np.int32)
    row = np.zeros((pairs, n), np.int32)
    best, best_i, best_j = (np.zeros(pairs, np.int64) for _ in range(3))
    every = np.arange(pairs)
    for i in range(one.shape[1]):
        value = np.where(two == one[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        value[:, 1:] += row[:, :-1]
        np.maximum(value, row + GAP, out=value)
        np.maximum(value, 0, out=value)
        # gaps along the row: the best value to the left, less what the way costs
        row = np.maximum.accumulate(value + slope, axis=1) - slope
        j = row.argmax(axis=1)
        better = row[every, j] > best
        best, best_i, best_j = np.where(better, row[every, j], best), np.where(better, i, best_i), np.where(better, j, best_j)
    return best, best_i, best_j


def _padded(words: np.ndarray, low: np.ndarray, high: np.ndarray, fill: int, backwards: bool = False) -> np.ndarray:
    width = np.arange(max(1, int((high - low).max(initial=0))))
    at = (high[:, None] - 1 - width) if backwards else (low[:, None] + width)
    inside = width < (high - low)[:, None]
    return np.where(inside, words[np.where(inside, at, 0)], np.uint64(fill))


def _leaks(texts: pa.Array, seeds: Seeds, size: int, threshold: float) -> pa.Array:
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    data, offsets = buffer_of(texts)
    for low, high in slices(offsets):
        _search(data, offsets[low : high + 1], seeds, size, threshold, found[low:high])
    return pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_char", pa.int32()), ("end_char", pa.int32())])))


def _search(data: np.ndarray, offsets: np.ndarray, seeds: Seeds, size: int, threshold: float, found: list[list[dict]]) -> None:
    words = words_of(data, offsets, PUNCTUATION)
    text, shingle, at = shingles_of(words, size, short=False)
    near, gram = _lookup(seeds.gram, seeds.bitmap, shingle)
    if not len(near):
        return
    count = seeds.count[gram]
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(seeds.first[gram], count) + number
    text, at = np.repeat(text[near], count), np.repeat(at[near], count)
    passage = seeds.passage[place]
    begin, length = seeds.passages.begin, np.diff(seeds.passages.begin)
    per_text = np.bincount(words.text, minlength=words.texts)
    ends = np.cumsum(per_text)
    first = (ends - per_text)[text]
    # where the passage would begin, in steps of its length
    step = (at - seeds.place[place] - first) // length[passage]
    tries = np.unique(np.stack([text, passage, step]), axis=1)
    text, passage, step = tries
    length = length[passage]
    slack = length // 4 + 2
    first = (ends - per_text)[text]
    low = np.maximum(first, first + step * length - slack)
    high = np.minimum(ends[text], first + (step + 2) * length + slack)
    order = np.argsort(length, kind="stable")
    best: dict[tuple[int, int | None], tuple] = {}
    done = 0
    while done < len(order):
        widest = int((high - low)[order[done:]].max()) * int(length[order[-1]])
        some = order[done : done + max(1, CELLS // max(1, widest))]
        done += len(some)
        p = passage[some]
        score, i, j = align(
            _padded(seeds.passages.words, begin[p], begin[p + 1], 0), _padded(words.hash, low[some], high[some], 1)
        )
        share = score / (MATCH * length[some])
        good = np.flatnonzero(share >= threshold)
        if not len(good):
            continue
        some, p = some[good], p[good]
        end = low[some] + j[good] + 1
        # the same alignment backwards, from its end, tells where it begins
        _, _, back = align(
            _padded(seeds.passages.words, begin[p], begin[p] + i[good] + 1, 0, True), _padded(words.hash, low[some], end, 1, True)
        )
        for k in range(len(good)):
            key = (int(text[some[k]]), seeds.passages.item[int(p[k])])
            value = (float(share[good[k]]), -int(end[k] - 1 - back[k]), int(end[k] - 1))
            best[key] = max(best.get(key, value), value)
    letters = (data & 0xC0) != 0x80 if best else None
    for (i, item), (score, start, last) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0)):
        chars = [int(letters[offsets[i] : at].sum()) for at in (words.start[-start], words.end[last])]
        found[i].append({"item_id": item, "score": score, "first_char": chars[0], "end_char": chars[1]})


def leaks(
    docs: DataFrame, items: DataFrame, text: Column | str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = SEED_WORDS, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> Column:
    """A column over ``docs``: the items each whole text holds, with score (1 is verbatim) and code points, end exclusive.

    An item is reported once per text, by its best place; items that repeat count once. Words are runs of ASCII letters and digits and of all
    other characters beyond ASCII, A-Z lower-cased. Items of null or of fewer than five words are never found; null
    and empty texts hold nothing, and so does any text if there are no items.
    """
    rows = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("passage"))
    rows = rows.where("length(passage) > 0").distinct()
    blocks = -(-(rows.agg(F.sum(F.octet_length("passage"))).first()[0] or 0) // block_bytes)
    text = F.col(text) if isinstance(text, str) else text
    text = text.cast("string")
    texts = docs.select(text.alias("text"))
    found = F.array().cast(FOUND)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == block).collect()
        passages = passages_of(sorted(((r.item, r.passage) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])), size)
        if not passages.item:
            continue
        every = np.unique(passages.gram)
        bitmap = np.zeros(65536, bool)
        bitmap[every & np.uint64(65535)] = True
        counts = texts.mapInArrow(partial(_document_counts, gram=every, bitmap=bitmap, size=size), "gram bigint, n bigint")
        frequency = {r.gram: r.n for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        found = F.concat(found, _leak_column(text, seeds_of(passages, frequency), size, threshold))
    return found


def _leak_column(text: Column, seeds: Seeds, size: int, threshold: float) -> Column:
    @F.arrow_udf(FOUND)
    @tidied
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _leaks(texts, seeds, size, threshold)

    return of(text)


def find_leaks(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """One row (doc_id, item_id, score, first_char, end_char) per document and item that it holds."""
    found = docs.select("doc_id", F.explode(leaks(docs, items, **settings)).alias("leak"))
    return found.select("doc_id", "leak.*")


def without_leaks(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    return docs.where(F.size(leaks(docs, items, **settings)) == 0)
