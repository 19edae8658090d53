"""Benchmark passages in documents: item-sized windows, SimHash blocks, exact similarity.

Every benchmark item has the SimHash of its word shingles.  A document is compared in
windows as long as the item.  Fingerprints of windows probe a multi-index of four blocks of
bits: of two fingerprints within the radius at least one block differs in no more than a
quarter of the radius, so the index, which files items under all such values, returns all.
Candidates are verified by the weighted Jaccard similarity of the shingles, a shingle
weighing as often as it occurs.

Windows that share no shingle with an item have similarity zero, so only windows around a
shared shingle get fingerprints; the shared shingles are found by one rolling hash over
the whole text.  Items are few against documents; they travel to the tasks in blocks of
``ITEMS`` at most, each block with a pass of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.tokens import LOWER, WHITE, Words, buffers, distinct, pieces

ITEMS = 4096
RADIUS = 15
BLOCKS = 4
_APART = WHITE.copy()
_APART[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # ASCII marks
_SIEVE = 1 << 22


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words without ASCII punctuation, A-Z in lower case."""
    return Words(data, offsets, _APART, LOWER)


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Bits of each hash, one column per bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)[:, 0]


class BlockIndex:
    """Fingerprints by the values near those of their four blocks of 16 bits.

    Of two fingerprints within ``radius`` bits at least one block differs in a quarter of
    them or fewer, so each fingerprint is filed, block by block, under every value that
    near to its own, and one look-up a block finds them all.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        values = np.arange(1 << 16, dtype=np.uint16)
        flips = values[np.bitwise_count(values) <= radius // BLOCKS]
        self.tables = []
        for block in range(BLOCKS):
            near = (self._block(prints, block)[:, None] ^ flips).ravel()
            order = np.argsort(near, kind="stable")
            self.tables.append((near[order], (order // len(flips)).astype(np.int32)))

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        return (prints >> np.uint64(16 * block)).astype(np.uint16)

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Asked and indexed fingerprints that meet in some block, once each."""
        pairs = [np.zeros(0, np.int64)]
        for block, (values, item) in enumerate(self.tables):
            own = self._block(asked, block)
            a = np.searchsorted(values, own, "left")
            n = np.searchsorted(values, own, "right") - a
            at = np.repeat(np.arange(len(asked)), n)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(at * len(self.prints) + item[np.repeat(a, n) + inner])
        pairs = distinct(np.concatenate(pairs))
        return pairs // len(self.prints), pairs % len(self.prints)

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of asked and indexed fingerprints within the radius."""
        at, item = self.candidates(asked)
        near = np.bitwise_count(asked[at] ^ self.prints[item]) <= self.radius
        return at[near], item[near]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return both / max(1, len(a) + len(b) - both)


class Items:
    """Benchmark items, their shingles, and an index per item length."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int, radius: int):
        text = pa.array([t or "" for _, t in rows], pa.string())
        words = words_of(*buffers(text))
        hashes = words.hashes()
        self.shingle, self.ids, self.bags = shingle, [], []
        lengths, widths = [], []
        for i, (item, _) in enumerate(rows):
            n = int(words.counts[i])
            if not n or item is None:
                continue
            width = min(shingle, n)
            one = _Slice(hashes[words.first[i]:words.first[i + 1]])
            self.ids.append(item)
            self.bags.append(one.shingles(width))
            lengths.append(n)
            widths.append(width)
        self.lengths, self.widths = np.array(lengths, np.int64), np.array(widths, np.int64)
        self.groups = {}
        for n in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == n)
            prints = _packed(np.stack([2 * simhash(self.bags[i]).sum(0, dtype=np.int64) > len(self.bags[i]) for i in own]))
            self.groups[int(n)] = (own, BlockIndex(prints, radius))
        self.sieves = {}
        for width in np.unique(self.widths):
            own = np.flatnonzero(self.widths == width)
            flat = np.concatenate([self.bags[i] for i in own])
            owner = np.repeat(self.lengths[own], [len(self.bags[i]) for i in own])
            order = np.lexsort((owner, flat))
            sieve = np.zeros(_SIEVE, bool)
            sieve[flat & np.uint64(_SIEVE - 1)] = True
            self.sieves[int(width)] = (sieve, flat[order], owner[order])

    def shared(self, width: int, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are shingles of some item."""
        sieve, flat, _ = self.sieves[width]
        maybe = np.flatnonzero(sieve[hashes & np.uint64(_SIEVE - 1)])
        at = np.minimum(np.searchsorted(flat, hashes[maybe]), len(flat) - 1)
        return maybe[flat[at] == hashes[maybe]]

    def lengths_of(self, width: int, h: np.uint64) -> np.ndarray:
        _, flat, owner = self.sieves[width]
        return np.unique(owner[np.searchsorted(flat, h, "left"):np.searchsorted(flat, h, "right")])


class _Slice:
    """Word hashes of one text."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def shingles(self, width: int) -> np.ndarray:
        one = Words.__new__(Words)
        one.first, one.counts = np.array([0, len(self.hashes)]), np.array([len(self.hashes)])
        return one.windows(width, self.hashes)[1]


def _matches(items: Items, width: int, shingles: np.ndarray, hits: np.ndarray, least: float) -> dict:
    """Best ``(similarity, first word, words, bits)`` of each item in one document."""
    around: dict[int, list[int]] = {}
    for p in hits:
        for n in items.lengths_of(width, shingles[p]):
            around.setdefault(int(n), []).append(int(p))
    best: dict[int, tuple] = {}
    for n, at in around.items():
        own, index = items.groups[n]
        m = min(n - width + 1, len(shingles))  # shingles of a window; a short text is one window
        starts = distinct(np.concatenate([np.arange(max(0, p - m + 1), min(p, len(shingles) - m) + 1) for p in at]))
        for some in np.array_split(starts, -(-len(starts) // 4096)):
            a, b = int(some[0]), int(some[-1]) + m
            if b - a > 8 * (len(some) + m):  # sparse: take the windows one by one
                sums = np.stack([simhash(shingles[s:s + m]).sum(0, dtype=np.int64) for s in some])
            else:
                total = np.zeros((b - a + 1, 64), np.int64)
                np.cumsum(simhash(shingles[a:b]), axis=0, out=total[1:])
                sums = total[some - a + m] - total[some - a]
            prints = _packed(2 * sums > m)
            for w, i in zip(*index.within(prints), strict=True):
                item, s = int(own[i]), int(some[w])
                score = similarity(shingles[s:s + m], items.bags[item])
                if score >= least and (item not in best or score > best[item][0]):
                    best[item] = (score, s, m + width - 1, int(np.bitwise_count(prints[w] ^ index.prints[i])))
    return best


def find_benchmark(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = RADIUS,
                   text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``matches``: item, first word, words, similarity, bits that differ.

    A document matches an item if one of its windows of the item's number of words (the
    whole text if it is shorter) has a fingerprint within ``radius`` bits of the item's and
    a weighted shingle similarity of ``least`` or more; the best window is returned.  Words
    are runs between ASCII white space and punctuation, A-Z in lower case; items of fewer
    words than a shingle are one shingle.  Null and empty texts and items match nothing;
    items without an id are left out; repeated items match each.  Other columns are not
    read; an empty table gives an empty one, an empty benchmark no matches.
    """
    matched = _matched(docs, benchmark, shingle, least, radius, text, keep)
    return matched.select(*keep, F.col("__matches").alias("matches"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8,
                      radius: int = RADIUS, text: str = "text") -> DataFrame:
    """``docs`` without the rows that match an item; all columns, whatever their names."""
    matched = _matched(docs, benchmark, shingle, least, radius, text, tuple(docs.columns))
    return matched.filter(F.size("__matches") == 0).drop("__matches")


def _matched(docs: DataFrame, benchmark: DataFrame, shingle: int, least: float, radius: int, text: str,
             keep: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    at = keep.index(text) if text in keep else len(keep)
    frame = docs.select(*keep, *([] if text in keep else [F.col(text).alias("__text")]),
                        F.array().cast(_MATCHES).alias("__matches"))
    held = benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator()
    rows = list(islice(held, ITEMS))
    while rows:
        items = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in rows], shingle, radius))
        rows = list(islice(held, ITEMS))
        names = frame.columns if rows else [*keep, "__matches"]  # the last pass needs the text no more
        kinds = dict(frame.dtypes)
        frame = frame.mapInArrow(_pass(items, at, names, least), ", ".join(f"`{n}` {kinds[n]}" for n in names))
    return frame.select(*keep, "__matches")


_MATCHES = "array<struct<item_id:bigint,first_word:bigint,n_words:bigint,similarity:double,bits:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()),
                             ("similarity", pa.float64()), ("bits", pa.int32())]))


def _pass(items, at: int, names: list[str], least: float):
    """Adds the matches of one block of items to those that the rows bring along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        for batch in batches:
            found = batch.column(batch.num_columns - 1).to_pylist()
            data, offsets = buffers(batch.column(at))
            for a, b in pieces(offsets):
                words = words_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                hashes = words.hashes()
                for width in known.sieves:
                    begin, h = words.windows(width, hashes)
                    hit = known.shared(width, h)
                    text_of = np.searchsorted(words.first, begin[hit], "right") - 1
                    for t in np.unique(text_of):
                        lo, hi = np.searchsorted(begin, (words.first[t], words.first[t + 1]))
                        own = _matches(known, width, h[lo:hi], hit[text_of == t] - lo, least)
                        found[a + t] += [
                            dict(item_id=known.ids[i], first_word=s, n_words=n, similarity=score, bits=bits)
                            for i, (score, s, n, bits) in sorted(own.items())]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _ARROW)], names)

    return run
