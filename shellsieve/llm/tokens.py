"""Splitting and hashing of UTF-8 texts held in Arrow buffers, whole batches at a time.

A word's hash is the sum, modulo 2**64, of a mixed number for each byte at its place in the
word.  (A polynomial over the bytes would not do: modulo a power of two there are pairs of
words that collide whatever its base.)  A window's hash is a polynomial over its words'
hashes.  Both are differences of running sums, so no Python object is made for a word.  Each
hash is mixed afterwards; equal words and windows always have equal hashes, and different
ones share one of 2**64 by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240613))
_BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_PLACE_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASES = {"window": 0xD6E8FEB86659FD93 | 1}
_powers: dict[tuple[str, bool], np.ndarray] = {}


def _power(kind: str, inverse: bool, n: int) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get((kind, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[kind], -1, 2**64) if inverse else _BASES[kind]
        steps = np.full(max(n, PIECE_BYTES + 2), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= PIECE_BYTES + 2:  # those of a very long text are not kept
            _powers[kind, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is many times faster here than ``np.unique``'s hashing."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array; a bit table spares most of the searches."""
    found = np.zeros(len(values), bool)
    if not len(among):
        return found
    low = values.dtype.type((1 << 22) - 1)
    sieve = np.zeros(1 << 22, bool)
    sieve[among & low] = True
    maybe = np.flatnonzero(sieve[values & low])
    at = np.searchsorted(among, values[maybe])
    at[at == len(among)] = 0
    found[maybe[among[at] == values[maybe]]] = True
    return found


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if large else np.int32)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind.itemsize)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text is a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(stop, n)
        row = min(stop, n)


def count_words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> np.ndarray:
    """Words of each text, without listing them."""
    if len(data) == 0:
        return np.zeros(len(offsets) - 1, np.int64)
    solid = ~white[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[heads] = solid[heads]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begin, out=sums[1:])
    return np.diff(sums[offsets])


class Words:
    """The words of some texts: byte ranges, first word of each text, hashes.

    ``starts`` and ``ends`` are byte positions in ``data``; the words of text ``i`` are
    ``first[i]:first[i + 1]``.  ``white`` says which bytes part words, ``fold`` maps
    bytes before hashing.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE,
                 fold: np.ndarray | None = None):
        self.data = data if fold is None else fold[data]
        solid = ~white[data]
        n = len(data)
        begin, last = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        filled = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        begin[heads], last[tails] = solid[heads], solid[tails]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if n == 0:
            self.first = np.zeros(len(offsets), np.int64)
        self.counts = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        place = np.arange(n, dtype=np.uint64)
        lengths = np.diff(np.r_[self.starts, n])
        if len(self.starts):
            place[self.starts[0]:] -= np.repeat(self.starts, lengths).astype(np.uint64)
        # One round of mixing for each byte and place: nonlinear, so that no pattern cancels out.
        place *= _PLACE_STEP
        place ^= _BYTE_VALUE[self.data]
        place ^= place >> np.uint64(32)
        place *= np.uint64(0xD6E8FEB86659FD93)
        place ^= place >> np.uint64(32)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(place, out=sums[1:])
        return mix(sums[self.ends] - sums[self.starts])

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words within one text."""
        hashes = self.hashes() if hashes is None else hashes
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _power("window", False, n), out=sums[1:])
        ends = np.repeat(self.first[1:], self.counts)
        begin = np.flatnonzero(np.arange(n) + size <= ends)
        return begin, mix((sums[begin + size] - sums[begin]) * _power("window", True, n + 1)[begin])
