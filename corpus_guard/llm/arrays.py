"""Vectorised helpers on the texts of an Arrow batch; used inside tasks only.

Texts are taken as UTF-8 bytes straight from Arrow's buffer. Words are maximal runs of bytes other
than space and 0x09-0x0D. All hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one block of work covers; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18

#: An odd base of polynomial hashes, and its inverse modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX_1
    values = values ^ (values >> np.uint64(27))
    values = values * _MIX_2
    return values ^ (values >> np.uint64(31))


def salted(values: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of another family than the values themselves."""
    return mix(values + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (first, last + 1) of texts that hold about ``size`` bytes; never an empty range."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


#: Blanks and all other ASCII characters that are neither letter nor digit.
NO_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def word_spans(
    data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of every word; no word reaches over the end of a text."""
    return spans(~blank[data], offsets)


def spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of every longest run of true bytes within a text."""
    if not len(solid):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    cut = np.unique(inner[inner < len(solid)])
    before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_powers = np.ones(1, np.uint64)


def _powers_to(length: int) -> np.ndarray:
    global _powers
    if len(_powers) < length:
        _powers = np.cumprod(np.full(max(length, 2 * len(_powers)), BASE, np.uint64))
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: a polynomial in an odd base, mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    values *= _powers_to(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, firsts) ^ (lengths.astype(np.uint64) << np.uint64(48)))


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes data[starts[i]:ends[i]] in a row, and len + 1 offsets into them."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[place], offsets


def grams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of one text, and the number of that text."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, owner.dtype)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total = total * BASE + hashes[i : i + count]
    inside = owner[:count] == owner[n - 1 :]
    return salted(total[inside], n), owner[:count][inside]


def distinct_pairs(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, key) once, by text and then by key."""
    if not len(keys):
        return owner, keys
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], keys[new]


class KeyTable:
    """Places of 64-bit keys, found for a whole array of keys at once (open addressing)."""

    def __init__(self, keys: np.ndarray):
        """``keys`` are distinct."""
        self.bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)
        self.place = np.full(size, -1, np.int32)
        self.rounds = 0
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.place[slot] < 0
            winner = np.full(size, -1, np.int64)
            winner[slot[free]] = left[free]
            won = winner[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            self.place[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & (size - 1)
            self.rounds += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX_1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the keys the table was made of, -1 where it is none."""
        slot = self._slot(keys)
        found = self.place[slot]
        miss = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        for _ in range(self.rounds):
            if not len(miss):
                break
            at = (slot[miss] + 1) & (len(self.keys) - 1)
            slot[miss] = at
            found[miss] = self.place[at]
            miss = miss[(found[miss] >= 0) & (self.keys[at] != keys[miss])]
        found[miss] = -1
        return found
