"""Word-wise use of a public tokenizer file.

The tokenizer drops white space, ignores the case of letters and keeps runs of letters apart from what follows them, so
a text's ids are the ids of its pieces one after another. Texts are cut in NumPy: at white space, before a closing mark
that follows a letter, and before a letter that follows a closing mark. Pieces are known by 128 bits of hashes; a bounded
open-addressing table leads from them to the ids, and only pieces not seen before reach the tokenizer library. A text that
may hold a special token, or a combining mark (where case and composition interact), goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from quarry.llm.words import _LOWER, _SPACE, SLICE, _buffers, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Marks that the tokenizer keeps apart from a letter on either side.
CLOSING = b"!#$%&*,./:;?|"
WORD_END = "</w>"
TOGETHER = 1000
TABLE_BITS = 22
_U = np.uint64

_closing = np.zeros(256, dtype=bool)
_closing[list(CLOSING)] = True
_letter = np.zeros(256, dtype=bool)
_letter[ord("a") : ord("z") + 1] = True
_second = np.zeros(256, dtype=bool)  # second bytes of two-byte Latin-1 letters
_second[0x80:0xC0] = True
_second[[0x97, 0xB7]] = False

_encoders: dict[str, Encoder] = {}


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``sizes[0]`` entries, and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def distinct(keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where each distinct pair of hashes stands first."""
    order = np.lexsort((keys[1], keys[0]))
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


class Table:
    """Open addressing from 128-bit keys (pairs of hashes) to entry numbers."""

    def __init__(self, bits: int):
        self.mask = _U((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=_U)
        self.more = np.zeros(1 << bits, dtype=_U)
        self.entry = np.full(1 << bits, -1, dtype=np.int32)
        self.room = 1 << (bits - 1)
        self.size = 0

    def find(self, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Entry numbers; -1 where a key is not known."""
        one, two = keys
        slot = (one & self.mask).astype(np.int64)
        out = self.entry[slot]
        open_ = np.flatnonzero(((self.keys[slot] != one) | (self.more[slot] != two)) & (out >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            at = slot[open_]
            out[open_] = self.entry[at]
            open_ = open_[((self.keys[at] != one[open_]) | (self.more[at] != two[open_])) & (out[open_] >= 0)]
        return out

    def add(self, keys: tuple[np.ndarray, np.ndarray]) -> None:
        """Give distinct unknown keys the next entry numbers, in order."""
        one, two = keys
        entry = np.arange(self.size, self.size + len(one), dtype=np.int32)
        slot = (one & self.mask).astype(np.int64)
        self.size += len(one)
        left = np.arange(len(one))
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.entry[slot[won]], self.keys[slot[won]], self.more[slot[won]] = entry[won], one[won], two[won]
            lost = np.ones(len(one), dtype=bool)
            lost[won] = False
            left = left[lost[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)


def cut(data: np.ndarray, at: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of consecutive texts in a lower-cased buffer: pairs of hashes, starts, ends, and the piece at which each text
    begins. ``at`` holds the texts' offsets and the buffer's length."""
    n = len(data)
    inside = ~_SPACE[data]
    opens = inside.copy()
    mark, letter = _closing[data], _letter[data]
    after = np.zeros(n, dtype=bool)  # the byte before ends a letter
    after[1:] = letter[:-1]
    after[2:] |= _second[data[1:-1]] & (data[:-2] == 0xC3)
    before = np.zeros(n + 1, dtype=bool)  # a text begins here
    before[at] = True
    opens[1:] &= ~inside[:-1] | before[1:n] | (mark[1:] & after[1:]) | (letter[1:] & mark[:-1])
    starts = np.flatnonzero(opens)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return (np.zeros(0, _U), np.zeros(0, _U)), starts, starts, first
    last = np.flatnonzero(np.concatenate([opens[1:] | ~inside[1:] | before[1:n], [True]]) & inside)
    return span_hashes(data, starts, last + 1), starts, last + 1, first


class Encoder:
    """Ids of texts with one tokenizer. The table lives as long as the Python worker and is emptied when full."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65536 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith(WORD_END)]] = True
        self.table = None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _empty(self, pieces: int = 0) -> None:
        """Begin anew, with room for at least so many pieces (a very long text may hold more than the usual table)."""
        self.table = Table(max(TABLE_BITS, (2 * pieces).bit_length()))
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, self.dtype), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype) for e in found]

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces. Words of letters go through the library many in one call."""
        words = [w.decode("utf-8", "replace") for w in pieces]
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        odd = [i for i, w in enumerate(words) if not w.isalpha()]
        out: list[np.ndarray] = [None] * len(words)
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                for i, x in zip(some, np.split(ids, ends[:-1]), strict=True):
                    out[i] = x
            else:  # a letter here that is none to the tokenizer
                odd += some
        for i, x in zip(odd, self.whole([words[i] for i in odd]), strict=True):
            out[i] = x
        return out

    def _learn(self, keys: tuple[np.ndarray, np.ndarray], pieces: list[bytes]) -> None:
        ids = self.pieces(pieces)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += total
        self.table.add(keys)

    def encode(self, column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
        """The ids of each text. Null counts as an empty text."""
        if self.table is None:
            self._empty()
        offsets, data = _buffers(column)
        n, d, out = len(offsets) - 1, 0, []
        while d < n:
            e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + SLICE, side="right")) - 1)
            out += self._slice(data[offsets[d] : offsets[e]], offsets[d : e + 1] - offsets[d])
            d = e
        return out

    def _slice(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        if not len(raw):
            return [np.zeros(0, self.dtype)] * (len(at) - 1)
        apart = (raw == 0xCC) | (raw == 0xCD)
        apart[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        whole = set((np.searchsorted(at, np.flatnonzero(apart), side="right") - 1).tolist())
        data = _LOWER[raw]
        keys, starts, ends, first = cut(data, at)
        entry = self.table.find(keys)
        if (entry < 0).any():
            where = np.flatnonzero(entry < 0)
            where = where[distinct((keys[0][where], keys[1][where]))]
            if self.table.size + len(where) > self.table.room:
                where = distinct(keys)
                self._empty(len(where))
            text = data.tobytes()
            new = keys[0][where], keys[1][where]
            self._learn(new, [text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            entry = self.table.find(keys)
        sizes = self.sizes[entry]
        ids = self.flat[spread(self.starts[entry], sizes)]
        edges = np.concatenate([[0], np.cumsum(sizes)])[first]
        out = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        for i in whole:
            out[i] = self.whole([raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")])[0]
        return out
