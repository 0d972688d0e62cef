"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 none of those bytes occurs
inside a longer character, so this equals the same rule on code points. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint8)
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[SPACES] = False

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def fold_case() -> np.ndarray:
    """A byte table which maps A-Z to a-z and leaves all else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
BYTE_VALUE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_FOLDED_VALUE = BYTE_VALUE[fold_case()]


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    both = []
    for base in (_BASE, _BASE_INVERSE):
        powers = np.full(n, base, dtype=np.uint64)
        powers[0] = 1
        both.append(np.cumprod(powers, dtype=np.uint64))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    return _powers(max(20, (max(n, 1) - 1).bit_length()))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0 and nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _trim():
    """The C library's function that gives free memory back, if it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give memory that is free back to the system: workers stay when their task is over, and others need it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text; then free memory is released."""
    _, offsets = string_buffers(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def word_bounds(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' byte ranges, and the index of each text's first word (one more than texts)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = word_byte[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range; ``folded``: with A-Z as a-z. Independent of where the range lies."""
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED_VALUE if folded else BYTE_VALUE)[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's runs of ``n`` words, with repeats; the whole text if it has fewer words, none without words."""
    if not len(words):
        return words, np.zeros(len(first), np.int64)
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(len(words))
    out = words
    for j in range(1, n):
        later = np.empty_like(words)
        later[: len(words) - j], later[max(len(words) - j, 0) :] = words[j:], 0
        out = np.where(left > j, mix64(out * _ODD + later), out)
    keep = left >= n
    keep[first[:-1][counts > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(np.where(counts > 0, np.maximum(counts - n + 1, 1), 0))])


def distinct_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's distinct shingles in ascending order."""
    data, offsets = string_buffers(texts)
    starts, ends, first = word_bounds(data, offsets)
    every, at = shingles(range_hashes(data, starts, ends), first, n)
    sets = [np.unique(every[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else every), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
