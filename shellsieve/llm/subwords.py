"""Bags of hashed words and character n-grams, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

SIZES = (3, 4, 5, 6)
_BASE = np.uint32(0x01000193)
_OPEN, _CLOSE = np.uint32(1), np.uint32(2)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case (Latin letters), and where each text starts."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    return points + (upper.astype(np.uint32) << 5), heads[offsets]


class Subwords:
    """Words of the texts and the hash buckets of their parts.

    Words are runs of letters and digits, and of anything beyond ASCII.  ``word`` is the
    word of each part, ``bucket`` its bucket, ``first`` the first word of each text.  The
    parts of a word are the word itself and its n-grams with marks at both ends, of the
    given sizes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int,
                 sizes_of_parts: tuple[int, ...] = SIZES):
        points, texts = _code_points(data, offsets)
        solid = (points >= 128) | ((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122))
        n = len(points)
        begin, last = solid.copy(), solid.copy()
        if n:
            begin[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            filled = texts[1:] > texts[:-1]
            begin[texts[:-1][filled]] = solid[texts[:-1][filled]]
            last[texts[1:][filled] - 1] = solid[texts[1:][filled] - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(starts, texts) if n else np.zeros(len(offsets), np.int64)
        sizes = ends - starts + 2
        stops = np.cumsum(sizes)
        word = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        marked = np.empty(len(word), np.uint32)
        inner = np.ones(len(word), bool)
        inner[stops - sizes] = False
        inner[stops - 1] = False
        marked[stops - sizes] = _OPEN
        marked[stops - 1] = _CLOSE
        marked[inner] = points[solid]
        left = np.repeat(stops, sizes) - np.arange(len(word))
        words, found = [], []
        h = marked.copy()
        for size in range(2, max(sizes_of_parts, default=0) + 1):
            h = h[:-1] * _BASE + marked[size - 1:] if len(h) > 1 else h[:0]
            if size in sizes_of_parts:
                whole = left[: len(h)] >= size
                words.append(word[: len(h)][whole])
                found.append(self._bucket(h[whole] + np.uint32(size), buckets))
        whole = np.zeros(len(starts), np.uint32)
        if len(starts):
            turned = (marked + np.uint32(7)) * self._powers(len(marked), stops - sizes, sizes)
            whole = np.add.reduceat(turned, stops - sizes, dtype=np.uint32)
        words.append(np.arange(len(starts), dtype=np.int32))
        found.append(self._bucket(whole, buckets))
        self.word, self.bucket = np.concatenate(words), np.concatenate(found)
        self.counts = np.diff(self.first)

    @staticmethod
    def _powers(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mixed position numbers inside each word."""
        at = (np.arange(n) - np.repeat(starts, sizes)).astype(np.uint32)
        at = (at + np.uint32(1)) * np.uint32(0x9E3779B1)
        return at ^ (at >> np.uint32(15)) | np.uint32(1)

    @staticmethod
    def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return ((h ^ (h >> np.uint32(16))) & np.uint32(buckets - 1)).astype(np.int32)

    def parts_per_word(self) -> np.ndarray:
        return np.bincount(self.word, minlength=int(self.first[-1]))
