"""SimHash near-duplicates through pivot distance tables.

Each distinct fingerprint gets a table of Hamming distances to many reference
fingerprints (pivots).  Two fingerprints within ``radius`` differ by at most ``radius`` in
every coordinate of the table, so a pair with a larger difference is discarded unseen, and
the rest is verified bit by bit.

Pairs are met inside buckets.  Distances to single pivots cannot make the buckets: those
of 64-bit fingerprints crowd around 32, so a ball around a pivot that parts the set leaves
69 % on either side with the overlap the radius needs.  Instead the fingerprint is cut
into ``b`` blocks and a bucket holds the fingerprints at distance zero from the same
reference on ``b - radius`` blocks: of any pair within the radius, some choice of blocks
agrees, so no pair is lost.  ``b`` follows the number of distinct fingerprints, so that
buckets stay at a few members at any size.

A bucket never emits all its pairs, only links that keep it connected.  Large buckets take
members as pivots: whatever lies within the radius of a pivot is linked to it at once, and
two such stars are compared only if the distances to their pivots allow a link, and only
until one is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.llm.components import components
from shellsieve.llm.storage import spare, written

SEED = 42
PIVOTS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 32, dtype=np.uint64)
BUCKET_MEMBERS = 4
LARGE_BUCKET = 48


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the word shingles of a UTF-8 text; zero if it has no words."""
    words = text.lower().split()  # for bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    width = min(width, len(words))
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(begins, ends[width - 1:].tolist(), strict=True)),
        np.uint64, len(begins),
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, width: int = 4, text: str = "text",
                      keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            values = [fingerprint(t.as_py() or b"", width) for t in texts]
            fp = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(fp)], [*keep, "fp"]
            )

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in chosen.dtypes[:-1]) + ", fp bigint"
    return chosen.mapInArrow(run, schema)


def block_choices(n: int, radius: int) -> list[int]:
    """Masks of the bits that must agree; enough bits for a few members a bucket."""
    blocks = radius + 2
    while n > BUCKET_MEMBERS * 2 ** (64 * (blocks - radius) / blocks) and blocks < 16:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(bits, blocks - radius)]


def _near_rows(f: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs ``(a, b)`` are links: coordinate differences first, then the bits."""
    for part in (slice(0, 4), slice(4, 12), slice(12, None)):
        gap = np.abs(table[a, part] - table[b, part]).max(1)
        a, b = a[gap <= radius], b[gap <= radius]
    keep = np.bitwise_count(f[a] ^ f[b]) <= radius
    return np.stack([a[keep], b[keep]])


def pivot_links(f: np.ndarray, key: np.ndarray, radius: int) -> np.ndarray:
    """Links inside runs of equal ``key``, enough to connect whatever is within the radius."""
    table = np.bitwise_count(f[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    large = np.repeat(sizes > LARGE_BUCKET, sizes)
    found = [np.zeros((2, 0), np.int64)]
    for lag in range(1, LARGE_BUCKET):
        a = np.flatnonzero((key[lag:] == key[:-lag]) & ~large[lag:])
        if not len(a):
            break
        found.append(_near_rows(f, a, a + lag, table, radius))
    for s, n in zip(starts[sizes > LARGE_BUCKET], sizes[sizes > LARGE_BUCKET], strict=True):
        found.append(s + _star_links(f[s:s + n], radius))
    return np.concatenate(found, 1)


def _star_links(f: np.ndarray, radius: int) -> np.ndarray:
    """Links of one large bucket, with members as pivots."""
    rest, stars, links = np.arange(len(f)), [], []
    while len(rest):
        near = np.bitwise_count(f[rest] ^ f[rest[0]]) <= radius
        stars.append(rest[near])
        links.append(np.stack([np.full(near.sum() - 1, rest[0]), rest[near][1:]]))
        rest = rest[~near]
    centres = f[np.array([s[0] for s in stars])]
    for i, star in enumerate(stars):
        apart = np.bitwise_count(centres[i + 1:] ^ centres[i])
        for j in i + 1 + np.flatnonzero(apart <= 3 * radius):
            # A member links across only if it is within twice the radius of the other pivot.
            a = star[np.bitwise_count(f[star] ^ centres[j]) <= 2 * radius]
            b = stars[j][np.bitwise_count(f[stars[j]] ^ centres[i]) <= 2 * radius]
            for x in a:
                hit = np.flatnonzero(np.bitwise_count(f[b] ^ f[x]) <= radius)
                if len(hit):
                    links.append(np.array([[x], [b[hit[0]]]]))
                    break
    return np.concatenate(links, 1)


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints ``fp`` that connect all within ``radius``."""
    spark = prints.sparkSession
    masks = [m - 2**64 if m >= 2**63 else m for m in block_choices(prints.count(), radius)]
    tagged = F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks)
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]
            group = np.cumsum(new)
            a, b = pivot_links(rows[2].view(np.uint64), group, radius)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[2][a]), pa.array(rows[2][b])], ["u", "v"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            held = np.concatenate([held, rows], 1)
            if not held.shape[1]:
                continue
            cut = np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1]))
            if len(cut):
                yield flush(np.ascontiguousarray(held[:, : cut[-1] + 1]))
                held = held[:, cut[-1] + 1:]
        if held.shape[1]:
            yield flush(np.ascontiguousarray(held))

    keyed = prints.select("fp", tagged.alias("t")).select("t.choice", "t.key", "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        keyed.repartition(parts, "choice", "key").sortWithinPartitions("choice", "key")
        .mapInArrow(run, "u bigint, v bigint").distinct()
    )


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, text: str = "text",
                    doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, ``keep`` columns, ``fp``, ``root`` and ``component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the least id reachable over links and ``root`` the least
    fingerprint.  A null or empty text has fingerprint zero and is linked like any other;
    repeated rows share a component; a null id never becomes a component's id (a component
    without any other has null).  Other columns of ``docs`` are not read, so their names do
    not matter.  An empty table gives none.
    """
    prints = written(with_fingerprints(docs, width, text, (doc_id, *keep)))
    distinct = written(prints.groupBy("fp").agg(F.min(doc_id).alias("least")))
    found = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(least, "root").select("fp", "root", "component_id"))
    return prints.join(classes, "fp").select(doc_id, *keep, "fp", "root", "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` without the copies: of each group one row stays, that of the least id.

    A row without an id stays only if its whole group has none.  Of rows that repeat an id
    the one whose text hashes lowest stays.
    """
    # Two hashes of id and text name a row; they are the only columns that are grouped.
    a, b, n = spare(docs.columns, "a", "b", "n")
    name = [F.xxhash64("doc_id", "text").alias(a), F.xxhash64("text", "doc_id").alias(b)]
    marked = near_duplicates(docs.select("doc_id", "text", *name), width, radius, keep=(a, b))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", a, b))
    chosen = marked.groupBy("root").agg(first.alias("row")).select(f"row.{a}", f"row.{b}")
    order = Window.partitionBy(a, b).orderBy(F.lit(0))
    return (
        docs.select("*", *name).join(chosen, [a, b], "left_semi")
        .withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).select(*docs.columns)
    )
