"""Byte-level BPE: texts to ids and back, as the ranks of a vocabulary file say.

A text is cut into words by a pattern. Every distinct word of a stretch of text starts as its bytes, and
the two neighbours whose joined bytes rank lowest are merged, the leftmost first, until no neighbours have a rank; all distinct
words are folded at once, one merge of each word at a time. Ids are looked up per word, and decoding concatenates
the pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.words import buffer_of, free_name, slices, tidied

#: Longer words are folded one by one.
LONG_WORD = 256
#: Distinct words that a task remembers.
REMEMBERED = 150_000
#: Bytes of text cut into words at a time.
STRETCH = 1 << 20
_NONE = np.int64(1) << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: per line a piece in base64 and its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks of pieces; every byte must be a piece, and ranks lie below 65,536."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) > 65535 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must lie below 65,536 and hold every byte")
        self.pattern = pattern
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        first = np.repeat(self.bytes, 256), np.tile(self.bytes, 256)
        self.first = self.rank(*first)  # of every two bytes
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.piece = pa.array(pieces, pa.large_binary())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of joined neighbours, or _NONE."""
        wanted = left << 16 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.merged[at], _NONE)

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], np.int64)
        single = np.flatnonzero(lengths > LONG_WORD)
        alone = {int(i): self.fold_long(words[i]) for i in single}
        here = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD))
        raw = np.frombuffer(b"".join(words[i] for i in here.tolist()), np.uint8)
        ids = self.bytes[raw]
        done_word, done_ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = lengths[here]
        word = np.repeat(here, size)
        rank = np.full(len(ids), _NONE)
        pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
        rank[:-1] = np.where(word[:-1] == word[1:], self.first[pair], _NONE)
        while len(ids):
            begin = np.cumsum(size) - size
            # the lowest rank of each word, the leftmost of equals
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), begin)
            going = best >> 32 < _NONE
            if not going.all():
                stays = np.repeat(going, size)
                done_word.append(word[~stays])
                done_ids.append(ids[~stays])
                shift = np.cumsum(~stays)
                ids, word, rank, size = ids[stays], word[stays], rank[stays], size[going]
                best = best[going]
                if not len(ids):
                    break
                at = (best & 0xFFFFFFFF) - shift[best & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            ids[at] = best >> 32
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one piece goes before each later merge
            ids, word, rank = ids[keep], word[keep], rank[keep]
            size = size - 1
            for left in (at, at - 1):
                left = left[left >= 0]
                right = np.minimum(left + 1, len(ids) - 1)
                joined = (word[left] == word[right]) & (left < right)
                rank[left] = np.where(joined, self.rank(ids[left], ids[right]), _NONE)
        done_word, done_ids = np.concatenate(done_word), np.concatenate(done_ids)
        if alone:
            done_word = np.concatenate([done_word, *[np.full(len(v), i) for i, v in alone.items()]])
            done_ids = np.concatenate([done_ids, *alone.values()])
        order = np.argsort(done_word, kind="stable")
        return done_ids[order], np.bincount(done_word, minlength=len(words))

    def fold_long(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length: the neighbours wait in a heap by rank and place."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
        waiting = [(int(r), i) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(waiting)
        pairs = None
        current = ranks.tolist() + [int(_NONE)]
        while waiting:
            rank, i = heapq.heappop(waiting)
            if current[i] != rank:
                continue
            pairs = pairs if pairs is not None else dict(zip(self.pairs.tolist(), self.merged.tolist(), strict=True))
            gone = after[i]
            ids[i], after[i], current[gone] = rank, after[gone], -1
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0:
                    right = after[left]
                    found = pairs.get(ids[left] << 16 | ids[right], int(_NONE)) if right < n else int(_NONE)
                    current[left] = found
                    if found < _NONE:
                        heapq.heappush(waiting, (found, left))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int64)

    def pieces(self, ids: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids, one after the other, and where each piece begins, with the end."""
        if ids.null_count:
            raise ValueError("an id is null")
        number = ids.to_numpy()
        if len(ids) and (number.min() < 0 or number.max() >= len(self.known) or not self.known[number].all()):
            raise ValueError("an id is not in the vocabulary")
        found = self.piece.take(ids)
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1]
        return memoryview(found.buffers()[2])[: ends[-1]], ends


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of start[1], and so on."""
    total = np.cumsum(count)
    out = np.repeat(start - (total - count), count)
    out += np.arange(len(out))
    return out


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class _Memory:
    """Ids of the words met so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.cut = vocabulary, regex.compile(vocabulary.pattern).findall
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.ids, self.start, self.count = (np.zeros(0, np.int64) for _ in range(3))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        if len(self.number) > REMEMBERED:
            self.forget()
        number, known = self.number, len(self.number)
        words, sizes = [], []
        for text in texts:
            cut = self.cut(text)
            sizes.append(len(cut))
            words.extend(map(number.__getitem__, cut))
        ids, count = self.vocabulary.fold([w.encode() for w in list(number)[known:]])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
        words = np.array(words, np.int64)
        count = self.count[words]
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *sizes])]
        return self.ids[_spread(self.start[words], count)].astype(np.int32), np.diff(ends)


def _ids_of(memory: _Memory, texts: pa.Array) -> pa.ListArray:
    _, offsets = buffer_of(texts)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for low, high in slices(offsets, STRETCH):
        found, count = memory.encode([t or "" for t in texts.slice(low, high - low).to_pylist()])
        ids.append(found)
        counts.append(count)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))


def _bytes_of(vocabulary: Vocabulary, lists: pa.ListArray) -> pa.Array:
    counts = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    ends, flat = np.concatenate([[0], np.cumsum(counts)]), lists.flatten()
    offsets, parts, total = [[0]], [], 0
    for low, high in slices(ends, 1 << 20):
        data, at = vocabulary.pieces(flat.slice(ends[low], ends[high] - ends[low]))
        offsets.append(total + at[ends[low + 1 : high + 1] - ends[low]])
        parts.append(data)
        total += len(data)
    offsets = np.concatenate(offsets).astype(np.int32)
    valid = pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(lists), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(parts))])


def encode(text: Column | str, vocabulary: Vocabulary) -> Column:
    """Ids of every whole text, without special tokens; null and empty texts have none."""

    @F.arrow_udf("array<int>")
    @tidied
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _Memory(vocabulary)
        for texts in batches:
            yield _ids_of(memory, texts)

    return of(text)


def decode(ids: Column | str, vocabulary: Vocabulary) -> Column:
    """The bytes of a list of ids; null stays null, and an id that the vocabulary lacks is an error."""

    @F.arrow_udf("binary")
    @tidied
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield _bytes_of(vocabulary, lists)

    return of(ids)


def both_ways(text: Column | str, vocabulary: Vocabulary) -> Column:
    """A struct (ids, bytes): the ids of every whole text, and what they decode to. One worker does both."""

    @F.arrow_udf("ids array<int>, bytes binary")
    @tidied
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _Memory(vocabulary)
        for texts in batches:
            ids = _ids_of(memory, texts)
            yield pa.StructArray.from_arrays([ids, _bytes_of(vocabulary, ids)], names=["ids", "bytes"])

    return of(text)


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The documents with their ids and n_tokens in place of the text, and whether decoding gave the text's bytes again (exact).

    Null texts have no ids and count as exact. Columns of the input named ids, n_tokens or exact, in any spelling, give way; others stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "n_tokens", "exact")])
    name = free_name(docs.columns, "_both")
    docs = docs.withColumn(name, both_ways(text, vocabulary))
    ids = F.col(f"{name}.ids")
    docs = docs.withColumns({"ids": ids, "n_tokens": F.size(ids).cast("bigint"), "exact": F.col(f"{name}.bytes") == text.cast("binary")})
    return docs.drop("text", name)


_BUCKETS = 1 << 16


def fold_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word by Spark's higher-order functions alone: the same fold over hexadecimal pieces.

    The ranks are a constant of buckets, because a lookup in a map walks through it. Meant for tables of distinct
    words; see the README on why texts are not encoded this way.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % _BUCKETS][key] = rank
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    look = lambda key: F.element_at(F.element_at(table, (F.crc32(key) % _BUCKETS + 1).cast("int")), key)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    raw = F.hex(word.cast("binary"))
    n = (F.length(raw) / 2).cast("int")
    first = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(raw, 2 * i - 1, F.lit(2)))

    def step(pieces: Column, _: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: look(F.concat(F.element_at(pieces, i), F.element_at(pieces, i + 1))))

        def merge(r: Column) -> Column:
            i = F.array_position(r, F.array_min(r)).cast("int")
            joined = F.array(F.concat(F.element_at(pieces, i), F.element_at(pieces, i + 1)))
            return F.when(F.array_min(r).isNull(), pieces).otherwise(
                F.concat(F.slice(pieces, F.lit(1), i - 1), joined, F.slice(pieces, i + 2, F.size(pieces)))
            )

        return F.when(F.size(pieces) < 2, pieces).otherwise(let(found, merge))

    folded = F.when(n < 2, first).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), first, step))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(folded, look))
