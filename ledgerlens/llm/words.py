"""Words and word shingles of many texts at once.

A batch of texts is one byte buffer with offsets, as Arrow holds it. Words are runs of bytes that are not ASCII
white space, letters A-Z count as a-z, and every word and shingle is a 64-bit number made from all of its bytes, so
that a batch costs a few numpy passes and no Python object per word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Bytes whose hashes are summed at a time.
_RUN = 1 << 19
_BASE = 0x9E3779B97F4A7C15


def free_name(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it in any spelling."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def tidied(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """The generator, giving back at its end what it has freed: workers are used again, and idle ones count as well."""

    @functools.wraps(work)
    def run(*args, **settings):
        yield from work(*args, **settings)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers (the finalizer of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


LETTER = seeds(256, 11)[LOWER]
_SHINGLE = seeds(64, 12)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _RUN), _powers(pow(_BASE, -1, 1 << 64), _RUN)


@dataclass
class Words:
    """Words of some texts in order: number of the text, byte range in the buffer, hash."""

    texts: int
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial in the bytes of each word, from running sums over stretches of the buffer."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        stop = max(at + 1, int(np.searchsorted(end, low + _RUN, "right")))
        size = int(end[stop - 1]) - low
        up, down = (_UP, _DOWN) if size <= _RUN else (_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(LETTER[data[low : low + size]] * up[:size], out=total[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = (total[e] - total[s]) * down[s]
        at = stop
    return mix(out)


def words_of(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; positions count from the start of ``data``.

    ``between`` tells for every byte whether it parts words.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    part = data[low:high]
    inside = ~between[part]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = np.unique(offsets) - low
    edge = edge[(edge > 0) & (edge < len(part))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first) + low, np.flatnonzero(last) + low + 1
    text = np.searchsorted(offsets, start, "right") - 1
    return Words(len(offsets) - 1, text, start, end, _hashes(data, start, end))


def shingles_of(words: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of ``size`` words: text, hash, number of the first word.

    With ``short``, a text of fewer words (one at least) gives its whole sequence as its only shingle.
    """
    n = len(words.hash)
    counts = np.bincount(words.text, minlength=words.texts)
    begins = np.cumsum(counts) - counts
    left = (begins + counts)[words.text] - np.arange(n)
    wanted = left >= size
    if short:
        whole = np.flatnonzero((counts > 0) & (counts < size))
        wanted[begins[whole]] = True
    at = np.flatnonzero(wanted)
    total = words.hash[at] * _SHINGLE[0]
    brief = np.flatnonzero(left[at] < size)
    for j in range(1, size):
        more = words.hash[np.minimum(at + j, n - 1)] * _SHINGLE[j]
        more[brief[left[at[brief]] <= j]] = 0
        total += more
    return words.text[at], mix(total), at


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with up to ``limit`` bytes together, or one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(stop, n)
        at = min(stop, n)


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, in that order."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[keep], value[keep]
