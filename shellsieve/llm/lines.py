"""Removal of lines that many documents share, with two Bloom filters before the shuffle.

Lines are split, folded and hashed once: every document's distinct keys are written as 128-bit
hashes, and both filter passes read those.  The first sends the bit positions of the keys, a
few bytes a line, to the owners of the filter's chunks.  They make two Bloom filters, of
what was seen once and of what was seen twice or more; merging them follows the rule for
two-step counters: twice is seen twice by either, or once by both.  Only the second filter
is needed further, and its size is a parameter, not a function of the data.

In the second pass only keys with all bits in the twice-filter are shuffled, as 128-bit
hashes, to confirm the repeats exactly and to choose the document that keeps the line.  A
filter that has filled up suspects more lines; results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.storage import written
from shellsieve.llm.tokens import buffers

BLANKS = " \t\n\x0b\x0c\r"
PROBES = 2
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30  # 128 MB at most are broadcast
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def key_of(line: str) -> str:
    return line.strip(BLANKS).translate(_UPPER) if not line.isascii() else line.strip(BLANKS).lower()


def long_keys(text: str, least: int) -> list[tuple[int, str]]:
    """Position and key of each line whose key is long enough to be judged."""
    return [(i, key) for i, line in enumerate(text.split("\n"))
            if len(line) >= least and len(key := key_of(line)) >= least]


def _digests(keys: list[str]) -> np.ndarray:
    """128-bit hashes, as two columns of unsigned 64-bit numbers."""
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(k.encode()) for k in keys])
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, 2)


def _positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key: one column per probe, a power of two in size."""
    step = digests[:, 1] | np.uint64(1)
    return np.stack([(digests[:, 0] + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], 1)


def _row_of(doc_id: str, text: str) -> Column:
    """Rows without an id are known by their text, so that they are many groups, not one."""
    return F.when(F.col(doc_id).isNull(), F.xxhash64(text))


def hashed_keys(source: DataFrame, least: int) -> DataFrame:
    """``doc_id``, ``row`` and ``keys``: the hashes of a text's distinct keys, 16 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            keys = []
            for text in batch.column(2):
                own = {k for _, k in long_keys(text.as_py() or "", least)}
                keys.append(b"".join([digest(k.encode()) for k in own]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.binary())], ["doc_id", "row", "keys"])

    return source.select("doc_id", "row", "text").mapInArrow(run, "doc_id bigint, row bigint, keys binary").filter(
        F.octet_length("keys") > 0)


def _read_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a batch and, for each, the row it belongs to."""
    data, offsets = buffers(column)
    digests = np.frombuffer(data.tobytes(), ">u8").astype(np.uint64).reshape(-1, 2)
    return digests, np.repeat(np.arange(len(column)), np.diff(offsets) // 16)


def twice_filter(keys: DataFrame, bits: int, chunk_bits: int = 1 << 21) -> np.ndarray:
    """Packed bits of the keys that two documents or more may hold; ``keys`` has ``keys`` alone."""
    chunk_bits = min(bits, chunk_bits)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owner = _read_keys(batch.column(0))
            # A document counts once for each bit: two of its keys that meet there are no repeat.
            at = _positions(digests, bits).ravel()
            owner = np.repeat(owner, PROBES)
            order = np.lexsort((owner, at))
            at, owner = at[order], owner[order]
            new = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])] if len(at) else np.zeros(0, bool)
            found = [at[new]]
            at, n = np.unique(np.concatenate(found), return_counts=True)
            chunk = (at // np.uint64(chunk_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(at) else [0]
            rows = [(int(chunk[a]), (at[a:b] % np.uint64(chunk_bits)).astype(np.uint32).tobytes(),
                     np.packbits(n[a:b] > 1).tobytes()) for a, b in zip(cuts, cuts[1:])]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                ["chunk", "at", "twice"])

    def merged(part: pa.Table) -> pa.Table:
        once, twice = np.zeros(chunk_bits, bool), np.zeros(chunk_bits, bool)
        for at, more in zip(part.column("at"), part.column("twice"), strict=True):
            at = np.frombuffer(at.as_py(), np.uint32)
            more = np.unpackbits(np.frombuffer(more.as_py(), np.uint8), count=len(at)).astype(bool)
            twice[at] |= more | once[at]
            once[at] = True
        return pa.table({"chunk": part.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(twice).tobytes()])})

    chunks = keys.mapInArrow(sent, "chunk bigint, at binary, twice binary").groupBy("chunk").applyInArrow(
        merged, "chunk bigint, bits binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in chunks.toLocalIterator():  # of the filter's fixed size altogether
        bitmap[row.chunk * chunk_bits // 8:(row.chunk + 1) * chunk_bits // 8] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def drop_shared_lines(docs: DataFrame, least: int = 20, documents: int = 3, bits: int | None = None,
                      text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept``, the text without shared lines.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower
    case.  A key of ``least`` code points or more that ``documents`` documents hold loses
    its lines in all but the document with the largest id.  Lines are parted by line feeds
    only; a null or empty text is one empty line.  Rows of one id count as one document; a
    row without an id counts as none and loses what others share.  Other columns are not
    read; an empty table gives an empty one.  ``bits``, a power of two, is the size of each
    Bloom filter; by default that of the texts in bytes divided by four, within fixed bounds.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    source = source.withColumn("row", _row_of("doc_id", "text"))
    if bits is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (size // 4).bit_length()))
    keys = written(hashed_keys(source, least))
    suspects = spark.sparkContext.broadcast(twice_filter(keys.select("keys"), bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = suspects.value
        for batch in batches:
            digests, owner = _read_keys(batch.column(2))
            at = _positions(digests, bits)
            hit = (bitmap[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(1)
            rows = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[hit, 0].view(np.int64)), pa.array(digests[hit, 1].view(np.int64)),
                 batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b", "doc_id", "row"])

    seen = written(keys.mapInArrow(suspected, "a bigint, b bigint, doc_id bigint, row bigint").distinct())
    shared = seen.groupBy("a", "b").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last"))
    # Written, so that both sides of the join are plain exchanges, whose hot keys Spark splits.
    shared = written(shared.filter(F.col("n") >= documents).drop("n"))
    lost = (
        seen.join(shared, ["a", "b"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
        .agg(F.collect_list(F.struct("a", "b")).alias("lost"))
    )
    lost = written(lost)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("row").eqNullSafe(F.col("__row"))
    joined = source.join(lost, same, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                lines = text.split("\n")
                n = len(lines)
                if gone.as_py():
                    drop = {(r["a"], r["b"]) for r in gone.as_py()}
                    keys = long_keys(text, least)
                    names = map(tuple, _digests([k for _, k in keys]).view(np.int64).tolist())
                    cut = {i for (i, _), name in zip(keys, names, strict=True) if name in drop}
                    lines = [x for i, x in enumerate(lines) if i not in cut]
                    text = "\n".join(lines)
                out.append((n, n - len(lines), text))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.select("doc_id", "text", "lost").mapInArrow(
        cut, "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")
