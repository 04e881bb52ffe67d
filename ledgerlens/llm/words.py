"""Vectorised word hashes of whole Arrow text columns.

A word is a run of bytes other than ASCII white space; its hash is a polynomial over the bytes (ASCII letters in
lower case), read off prefix sums, so no Python object is made per word. Texts are taken in slices of whole
documents, so memory is bounded by ``SLICE_BYTES`` or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_VALUES_LOWER = _VALUES[_LOWER]
_VALUES_WIDE = mix(np.arange(1, 0x251, dtype=np.uint64) * np.uint64(_ODD))  # of the code points below 0x250


KEPT_POWERS = 1 << 20


def _powers(n: int, base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))


_kept_powers = lru_cache(maxsize=2)(_powers)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of the base (or of its inverse) from 0; a task keeps a table of one size, longer ones are made anew."""
    base = pow(_ODD, -1, 1 << 64) if inverse else _ODD
    return _kept_powers(KEPT_POWERS, base)[:n] if n <= KEPT_POWERS else _powers(n, base)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of whole texts; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def bounds(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each text (plus one) the number of its first word. ``gaps`` tells
    for each byte whether it separates words."""
    ink = ~gaps[raw]
    opened = ink.copy()
    opened[1:] &= ~ink[:-1]
    closed = ink.copy()
    closed[:-1] &= ~ink[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    opened[edges] = ink[edges]  # a word never runs over the end of a text
    closed[edges - 1] = ink[edges - 1]
    starts = np.flatnonzero(opened)
    return starts, np.flatnonzero(closed) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_VALUES_LOWER if lower else _VALUES)[raw] * powers(len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(raw) + 1, True)[starts])


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words found by ``bounds`` (with A-Z in lower case) as numbers of the different ones, those, and a hash of each; words are told
    apart by their bytes."""
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    spelled = _LOWER[raw[~gaps[raw]]]
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(spelled)).dictionary_encode()
    terms = found.dictionary
    if not len(terms):
        return np.zeros(0, np.int32), terms, np.zeros(0, np.uint64)
    at = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    return found.indices.to_numpy(), terms, word_hashes(np.frombuffer(terms.buffers()[2], np.uint8)[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0])


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and for each text (plus one) the number of its first run.

    A text of fewer words has one run of all its words, an empty text none.
    """
    counts = np.diff(firsts)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(begins[-1]) + np.repeat(firsts[:-1] - begins[:-1], runs)
    length = np.repeat(np.minimum(counts, width), runs)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        out = out * np.uint64(_ODD) + np.where(k < length, padded[at + k], np.uint64(k + 1))
    return mix(out), begins


def bags(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order, how often each occurs, and where each text begins."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((values, owner)) if len(begins) > 2 else np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(values)))
    return values[at], counts, np.searchsorted(owner[at], np.arange(len(begins)))
