"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

In a uniform random permutation the number of rows that go from each source partition to
each shard follows a multivariate hypergeometric law.  That matrix is drawn first; then
every source partition permutes its rows and deals them out by its row of the matrix, the
rows are exchanged, and every shard permutes what it got.  The result is a uniform shuffle
and every shard has exactly its size.

Source partitions are hash partitions of the rows themselves, so a task that runs again
deals the same rows; their number follows the number of rows.  Both permutations order rows
by a seeded hash; a shard is numbered in ranges of that hash, so neither step gathers a
shard in one task.  Rows that repeat so often that their source would be many times as large
as others are written out once with a number each, which then tells them apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.llm.storage import spare, written

#: source partitions, and ranges of a shard, at least
SOURCES = 512
SLICES = 64
#: rows of a source or of a range that more of them keep it under
PART_ROWS = 1 << 18


def hypergeometric(rng: np.random.Generator, good: int, total: int, draws: int) -> int:
    """How many of ``draws`` rows, taken from ``total`` without return, are among ``good``.

    By inversion: probabilities relative to the mode, on all values or, beyond ten
    thousand, within 12 deviations of it.  No bound on the counts.
    """
    low, high = max(0, draws + good - total), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    share = good / total
    spread = (draws * share * (1 - share) * (total - draws) / max(1, total - 1)) ** 0.5
    if high - low > 10_000:
        low, high = max(low, mode - int(12 * spread) - 40), min(high, mode + int(12 * spread) + 40)
    up = np.arange(mode, high, dtype=np.float64)
    down = np.arange(mode, low, -1, dtype=np.float64)
    rest = float(total - good - draws)
    rising = np.cumprod((good - up) * (draws - up) / ((up + 1) * (rest + up + 1)))
    falling = np.cumprod(down * (rest + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([falling[::-1], [1.0], rising])
    sums = np.cumsum(weights)
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], "right").clip(0, len(sums) - 1))


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows from each source partition to each shard; margins are exactly the sizes given."""
    if sum(sources) != sum(shards):
        raise ValueError("sources and shards differ in rows")
    rng = np.random.Generator(np.random.PCG64(seed))
    left, matrix = list(shards), np.zeros((len(sources), len(shards)), np.int64)
    for i, draws in enumerate(sources):
        total = sum(left)
        for j, good in enumerate(left):
            n = hypergeometric(rng, good, total, draws)
            matrix[i, j], left[j] = n, good - n
            draws, total = draws - n, total - good
    return matrix


def exact_sizes(rows: int, shards: int) -> list[int]:
    """Shard sizes at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _parts(rows: int, least: int) -> int:
    return max(least, -(-rows // PART_ROWS))


def shuffle_into_shards(rows: DataFrame, shards: int = 40, seed: int = 17,
                        identity: tuple[str, ...] | None = None, sources: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniform shuffle, shard sizes at most one apart.

    ``identity`` names the columns whose values tell rows apart (default: all); rows that
    agree in them are exchangeable and still get a slot each.  Nulls hash like a value of
    their own.  Slots of a shard run from 0 without gaps.  Columns called ``shard`` or
    ``slot`` are replaced, all others kept whatever their names.  The same rows are dealt
    alike however they are partitioned, unless rows repeat more than a few times
    :data:`PART_ROWS` over.  An empty table gives an empty one.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    own = rows.columns
    source, first, second, ends, number, piece, before, mark = spare(
        own, "source", "first", "second", "ends", "number", "piece", "before", "mark")
    names = list(identity or own)
    total = rows.count()
    sources = sources or _parts(total, SOURCES)
    slices = _parts(-(-total // shards), SLICES)

    def place() -> tuple[DataFrame, list[int]]:
        drawn = lambda what: F.xxhash64(F.lit(f"{seed}/{what}"), *names)
        placed = rows.select("*", F.pmod(drawn("source"), F.lit(sources)).cast("int").alias(source),
                             drawn("first").alias(first), drawn("second").alias(second))
        counts = dict(map(tuple, placed.groupBy(source).count().collect()))  # at most `sources` rows
        return placed, [counts.get(i, 0) for i in range(sources)]

    placed, sizes = place()
    if max(sizes) > 4 * max(PART_ROWS, -(-total // sources)):
        rows = written(rows.withColumn(mark, F.monotonically_increasing_id()))
        names.append(mark)
        placed, sizes = place()
    matrix = communication_matrix(sizes, exact_sizes(sum(sizes), shards), seed)
    table = spark.createDataFrame(
        [(i, e.tolist()) for i, e in enumerate(np.cumsum(matrix, axis=1))], f"`{source}` int, `{ends}` array<bigint>")

    local = Window.partitionBy(source).orderBy(first, second)
    numbered = placed.withColumn(number, F.row_number().over(local)).join(F.broadcast(table), source)
    shard = F.size(F.filter(ends, lambda e: e < F.col(number))).cast("int")
    at: Column = F.floor((F.col(second) / (2**64 / slices)) + slices / 2).cast("int")
    kept = [*own, mark] if mark in names else own
    dealt = written(numbered.select(
        *kept, second, shard.alias("shard"), F.greatest(F.lit(0), F.least(at, F.lit(slices - 1))).alias(piece)))

    counts = {(r["shard"], r[piece]): r["count"] for r in dealt.groupBy("shard", piece).count().collect()}
    offsets = []
    for j in range(shards):
        start = 0
        for s in range(slices):
            offsets.append((j, s, start))
            start += counts.get((j, s), 0)
    offsets = spark.createDataFrame(offsets, f"shard int, `{piece}` int, `{before}` bigint")
    within = Window.partitionBy("shard", piece).orderBy(second, *[F.hash(n) for n in names])
    return (
        dealt.withColumn(number, F.row_number().over(within)).join(F.broadcast(offsets), ["shard", piece])
        .select(*own, "shard", (F.col(before) + F.col(number) - 1).alias("slot"))
    )
