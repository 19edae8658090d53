"""Exact top-k by inner product, by no-random-access aggregation.

The components of a block of vectors are sorted lists, one per dimension, best first for
the sign of a query's component.  All lists are read sequentially, a slice at a time, and
what is read is added to the partial scores of its vectors.  An entry that has not been read
is at most the value at the depth reached and at least the list's last one, which gives
every vector a lower and an upper bound.  A vector whose upper bound is under the ``k``-th
lower bound of its query cannot qualify and is dropped.  When few are left, the lists are
read on to their ends for these alone, which makes their scores final.  No entry is fetched
out of its list's order and none is used before it is read.

Vectors and queries are dealt into blocks; every block of queries meets every block of
vectors in a task of its own, and the best of each task are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.llm.storage import written

VECTOR_BLOCK = 8192
QUERY_BLOCK = 16384
#: queries whose partial scores are held at once
GROUP = 256
#: shares of the lists after which bounds are compared
DEPTHS = (0.125, 0.75, 0.875, 1.0)
_FOUND = ("query_id", "vec_id", "score", "entries")


class Lists:
    """The sorted lists of a block of vectors."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.size) = x, x.shape
        order = np.argsort(x, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(x, order, 0).T)
        self.place = np.empty(x.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[:, None], 0)

    def slices(self, j: int, begin: int, end: int):
        """Vectors and values from ``begin`` to ``end`` of list ``j``, from its top and from its bottom."""
        top, low = slice(self.n - end, self.n - begin), slice(begin, end)
        return (self.order[j, top], self.values[j, top]), (self.order[j, low], self.values[j, low])


class Reading:
    """Some queries' way through the lists: partial scores, open vectors, entries read."""

    def __init__(self, lists: Lists, q: np.ndarray, open_: np.ndarray):
        self.lists, self.open = lists, open_  # one row per vector, one column per query
        self.weights = [np.ascontiguousarray(w.T) for w in (np.maximum(q, 0), np.minimum(q, 0))]
        self.known = np.zeros(open_.shape, q.dtype)
        self.entries = np.zeros(len(q), np.int64)
        self.depth = 0

    def read(self, depth: int) -> None:
        """Add the next slice of every list to the partial scores.

        A slice of all lists is a matrix with its entries at their vectors and zero elsewhere,
        so that one product adds it for all queries.
        """
        lists, live = self.lists, self.open.any(axis=1)
        top = (lists.place >= lists.n - depth) & (lists.place < lists.n - self.depth)
        low = (lists.place >= self.depth) & (lists.place < depth)
        for part, weight in zip((top, low), self.weights, strict=True):
            part &= live[:, None]
            self.known += np.where(part, lists.x, 0) @ weight
            self.entries += np.count_nonzero(part, axis=0) @ (weight != 0)
        self.depth = depth

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds: what is known and, of what is not, the list's end or the depth's value."""
        lists, n = self.lists, self.lists.n
        if self.depth == n:
            return self.known, self.known
        up, down = self.weights
        unread_top = (lists.place < n - self.depth).astype(self.known.dtype)
        unread_low = (lists.place >= self.depth).astype(self.known.dtype)
        first, last = lists.values[:, :1], lists.values[:, -1:]
        high, low = lists.values[:, n - self.depth, None], lists.values[:, self.depth - 1, None]
        lower = self.known + unread_top @ (up * first) + unread_low @ (down * last)
        upper = self.known + unread_top @ (up * high) + unread_low @ (down * low)
        return lower, upper

    def close(self, k: int) -> None:
        """Drop the vectors that cannot be among a query's ``k`` best."""
        n = self.lists.n
        if n > k:
            lower, upper = self.bounds()
            worst = np.iinfo(np.int64).min if lower.dtype == np.int64 else -np.inf
            least = np.partition(np.where(self.open, lower, worst), n - k, axis=0)[n - k]
            self.open &= upper >= least

    def resolve(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, open vectors and final scores: the lists are read to their ends for these."""
        vector, query = np.nonzero(self.open)
        score = self.known[vector, query]
        count = np.bincount(vector, minlength=self.lists.n)
        begin = np.cumsum(count) - count
        for j in range(self.lists.size if self.depth < self.lists.n else 0):
            for (at, value), weight in zip(self.lists.slices(j, self.depth, self.lists.n), self.weights, strict=True):
                times = count[at]
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                pair = np.repeat(begin[at], times) + within
                own = weight[j][query[pair]]
                score[pair] += np.repeat(value, times) * own
                self.entries += np.bincount(query[pair[own != 0]], minlength=len(self.entries))
        self.depth = self.lists.n
        return query, vector, score


def aggregate(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int,
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector row and score of each query's ``k`` best, ties to the smaller id;
    and how many entries of the lists each query has used."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    # Integers are exact in these types up to here; beyond, in 64-bit integers.
    kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64
    lists, q = Lists(x.astype(kind)), q.astype(kind)
    steps = sorted({int(np.ceil(len(x) * share)) for share in DEPTHS})
    found = []
    for a in range(0, len(q), GROUP):
        reading = Reading(lists, q[a:a + GROUP], ids[:, None] != query_ids[None, a:a + GROUP])
        for depth in steps:
            reading.read(depth)
            reading.close(k)
            if 8 * np.count_nonzero(reading.open) < reading.open.size:
                break
        rows, columns, score = _best(*reading.resolve(), ids, k)
        found.append((rows + a, columns, score, reading.entries))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _best(rows, columns, score, ids, k):
    order = np.lexsort((ids[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    return rows[rank < k], columns[rank < k], score[rank < k]


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), size)


def _finder(k: int, names: tuple[str, ...]):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 4
        if vectors.num_rows and queries.num_rows:
            size = vectors.column("size")[0].as_py()
            ids = vectors.column("id").to_numpy()
            query_ids = queries.column("id").to_numpy()
            rows, columns, score, entries = aggregate(
                ids, _matrix(vectors.column("v"), size), query_ids, _matrix(queries.column("v"), size), k)
            found = [query_ids[rows], ids[columns], score.astype(np.int64), entries[rows]]
        return pa.Table.from_arrays([pa.array(c) for c in found[: len(names)]], names)

    return run


def scaled(vectors: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id`` and ``v``, the components as ``floor(scale * x)``, of the vectors that take part."""
    whole = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    finite = F.forall(embedding, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return (
        vectors.filter(F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))
    )


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vec_id: str = "vec_id",
          embedding: str = "embedding", entries: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best vectors of each query.

    With ``entries`` also ``entries``: how many list entries the query used in the block of
    vectors that a row comes from.

    Queries are the rows whose id ``every`` divides, candidates all rows of other ids,
    scores inner products of ``floor(scale * x)``.  Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part.  Vectors of different
    length never meet.  Ties go to the smaller id; repeated rows are candidates each, a
    repeated query is asked once.  Other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    ready = written(scaled(vectors, scale, vec_id, embedding).withColumn("size", F.size("v")))
    asked = ready.filter(F.pmod("id", F.lit(every)) == 0).distinct()
    blocks = -(-ready.count() // VECTOR_BLOCK) or 1
    asks = -(-asked.count() // QUERY_BLOCK) or 1
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = ready.withColumn("block", dealt(blocks)).withColumn("ask", every_block(asks))
    right = asked.withColumn("ask", dealt(asks)).withColumn("block", every_block(blocks))
    keys = ("size", "block", "ask")
    names = _FOUND if entries else _FOUND[:-1]  # no column that would be pruned again
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _finder(k, names), ", ".join(f"{n} bigint" for n in names))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", *names[3:])
    )
