"""Vectorised word and shingle hashing over Arrow string buffers.

A batch of texts is one byte buffer. Words are maximal runs outside ``[\\x20\\x09-\\x0D]``; every step below is a
NumPy pass over the buffer or over its words, so no Python object is made per word. Buffers are taken in slices
of about ``SLICE`` bytes (a longer text is a slice of its own), which bounds memory without cutting any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_U = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: three xor-shifts around two odd multiplications."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


LANES = 8  # words of more lanes of eight bytes are hashed one at a time
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)
_ODD = _U(0xD6E8FEB86659FD93)
_SEEDS = _U(0x9E3779B97F4A7C15), _U(0x632BE59BD9B4E019)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the bytes ``data[start:end]`` of each span.

    A span is read in lanes of eight bytes. Each lane passes through ``mix`` in two chains that start from the span's
    length, so that no pattern of bytes cancels (as it does in a polynomial modulo a power of two); the first hash is
    made of both chains, the second is one of them, and both together identify a span by 128 bits.
    """
    size = ends - starts
    one, two = mix(size.astype(_U) + _SEEDS[0]), mix(size.astype(_U) + _SEEDS[1])
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    own = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    for j in range(LANES):
        lane = lanes[starts[own] + 8 * j].view("<u8")[:, 0] & _TAIL[np.minimum(size[own] - 8 * j, 8)]
        whole = len(own) == len(one)
        first, second = mix((one if whole else one[own]) ^ lane), mix((two if whole else two[own]) + lane * _ODD)
        if whole:
            one, two = first, second
        else:
            one[own], two[own] = first, second
        own = own[size[own] > 8 * (j + 1)]
        if not len(own):
            break
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        digest = np.frombuffer(blake2b(data[starts[i] : ends[i]], digest_size=16).digest(), "<u8")
        one[i], two[i] = digest
    return mix(one + two * _ODD), two


@dataclass
class Words:
    """Words of some consecutive texts: ``first[d]:first[d + 1]`` are the words of text ``d``."""

    row: int  # index in the batch of the first text
    hashes: np.ndarray  # uint64, a hash of each word's bytes
    second: np.ndarray  # uint64, another; both together tell words apart by 128 bits
    starts: np.ndarray  # byte position of each word within its own text
    ends: np.ndarray
    first: np.ndarray  # word index at which each text begins, and the total
    counts: np.ndarray  # byte histogram, one row of 256 for each text, only if asked for


def _buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def scan(column: pa.Array | pa.ChunkedArray, lower: bool = False, histogram: bool = False) -> Iterator[Words]:
    """The words of each text, slice by slice. Null counts as an empty text."""
    offsets, data = _buffers(column)
    n, d = len(offsets) - 1, 0
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + SLICE, side="right")) - 1)
        yield _slice(data, offsets[d : e + 1], d, lower, histogram)
        d = e


def _slice(data: np.ndarray, offsets: np.ndarray, row: int, lower: bool, histogram: bool) -> Words:
    at = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    counts = None
    if histogram:
        counts = np.stack([np.bincount(raw[a:b], minlength=256) for a, b in zip(at[:-1], at[1:], strict=True)])
    if lower:
        raw = _LOWER[raw]
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(row, np.zeros(0, _U), np.zeros(0, _U), none, none, np.zeros(len(at), np.int64), counts)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[at] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, at)
    if not len(starts):
        return Words(row, np.zeros(0, _U), np.zeros(0, _U), starts, ends, first, counts)
    hashes, second = span_hashes(raw, starts, ends)
    text = np.repeat(at[:-1], np.diff(first))
    return Words(row, hashes, second, starts - text, ends - text, first, counts)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; meaningless where the text has fewer words left."""
    padded = np.concatenate([hashes, np.zeros(size, _U)])
    total = np.full(len(hashes), size, _U)
    for j in range(size):
        total = mix(total * _ODD + padded[j : j + len(hashes)])
    return total


def shingle_sets(w: Words, size: int, second: bool = False) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles; a text of fewer words is one
    shingle, a text without words has none. ``second`` asks for hashes independent of the first ones."""
    of = w.second if second else w.hashes
    hashes = window_hashes(of, size)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            s = np.sort(hashes[a : b - size + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield window_hashes(of[a:b], int(b - a))[:1]
        else:
            yield np.zeros(0, _U)
