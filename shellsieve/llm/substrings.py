"""Exact repeats of word runs, found through anchors on fixed blocks.

Every document is cut into non-overlapping blocks of half a window; the blocks are the
index.  Any window holds one whole block of its own document, so wherever the same words
stand again, some rolling block-sized window there meets that index entry.  Every rolling
window of every document probes.  Hits are anchors; around them whole windows are compared,
which extends an anchor to its maximal repeat: consecutive windows that repeat are one
longer repeat.

Documents are dealt into buckets by a hash.  A bucket sends each distinct hash once, so a
passage that stands in a third of all documents is one entry per bucket and partition, and
replies go to buckets.  Three jobs, with the replies written in between:

1. buckets send block hashes (index) and rolling hashes (probes), 4 bytes each;
2. buckets send the hashes of windows around anchors with the least id that holds them;
3. buckets remove what a smaller id, or an earlier start in the same document, repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.storage import written
from shellsieve.llm.tokens import Words, buffers, distinct, in_sorted, pieces

BUCKET_BYTES = 24 << 20
NO_ID = np.iinfo(np.int64).max


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy()


def _texts(table: pa.Table) -> Iterator[tuple[int, Words]]:
    """The words of a bucket's documents, some megabytes at a time, with the first row."""
    data, offsets = buffers(table.column("text").combine_chunks())
    for a, b in pieces(offsets):
        yield a, Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def _send(q: int, parts: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows ``(part, q, bytes...)`` of the columns, cut where ``key`` (sorted) changes its part."""
    cuts = np.searchsorted(key, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
    for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield (int(p), q, *(c[cuts[p]:cuts[p + 1]].tobytes() for c in columns))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
        if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _routed(h: np.ndarray, parts: int) -> np.ndarray:
    """Part in the upper, the rest of the hash in the lower 32 bits."""
    return ((h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


_BLOCKS = pa.schema([("part", pa.int32()), ("q", pa.int32()), ("once", pa.binary()),
                     ("more", pa.binary()), ("probes", pa.binary())])
_HITS = pa.schema([("q", pa.int32()), ("part", pa.int32()), ("hits", pa.binary())])
_WINDOWS = pa.schema([("part", pa.int32()), ("q", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary())])
_EARLIER = pa.schema([("q", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                   ("kept", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _block_sender(block: int, parts: int):
    def run(bucket: pa.Table) -> pa.Table:
        q, index, probes = bucket.column("q")[0].as_py(), [], []
        for _, words in _texts(bucket):
            begin, h = words.windows(block)
            aligned = (begin - np.repeat(words.first[:-1], words.counts)[begin]) % block == 0
            key = _routed(h, parts)
            index.append(key[aligned])
            probes.append(key[~aligned])
        index, n = np.unique(np.concatenate(index), return_counts=True)
        probes = distinct(np.concatenate(probes))
        both = in_sorted(index, probes)
        probes = probes[~in_sorted(probes, index)]
        more = (n > 1) | both
        rows: dict[int, list] = {}
        for at, values in enumerate((index[~more], index[more], probes)):
            for p, _, sent in _send(q, parts, values, values.astype(np.uint32)):
                rows.setdefault(p, [p, q, b"", b"", b""])[2 + at] = sent
        return _table([tuple(r) for r in rows.values()], _BLOCKS)

    return run


def _block_matcher(part: pa.Table) -> pa.Table:
    """Block hashes that stand somewhere else too, told to each bucket that has them."""
    read = [[np.frombuffer(x.as_py(), np.uint32) for x in part.column(c)] for c in ("once", "more", "probes")]
    index, n = np.unique(np.concatenate(read[0] + read[1]), return_counts=True)
    more = distinct(np.concatenate(read[1]))
    probes = distinct(np.concatenate(read[2]))
    repeated = index[(n > 1) | in_sorted(index, more) | in_sorted(index, probes)]
    p, rows = part.column("part")[0].as_py(), []
    for q, *own in zip(part.column("q").to_pylist(), *read, strict=True):
        own = np.concatenate(own)
        own = own[in_sorted(own, repeated)]
        if len(own):
            rows.append((q, p, own.tobytes()))
    return _table(rows, _HITS)


def _window_sender(window: int, block: int, parts: int):
    def run(bucket: pa.Table, hits: pa.Table) -> pa.Table:
        if not bucket.num_rows or not hits.num_rows:
            return _table([], _WINDOWS)
        anchors = distinct(np.concatenate([
            np.frombuffer(h.as_py(), np.uint32).astype(np.uint64) | np.uint64(p.as_py() << 32)
            for p, h in zip(hits.column("part"), hits.column("hits"), strict=True)]))
        ids, q, found_h, found_id = _ids(bucket), bucket.column("q")[0].as_py(), [], []
        for row, words in _texts(bucket):
            w = words.hashes()
            begin, h = words.windows(block, w)
            anchored = np.zeros(len(w) + window + 1, np.int64)
            anchored[1 + begin[in_sorted(_routed(h, parts), anchors)]] = 1
            anchored = np.cumsum(anchored)
            begin, h = words.windows(window, w)
            near = anchored[begin + window - block + 1] > anchored[begin]
            found_h.append(h[near])
            found_id.append(ids[row + np.searchsorted(words.first, begin[near], "right") - 1])
        h, who = np.concatenate(found_h), np.concatenate(found_id)
        order = np.lexsort((who, h))
        h, who = h[order], who[order]
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        h, who = h[first], who[first]
        key = _routed(h, parts)
        order = np.argsort(key, kind="stable")
        return _table(list(_send(q, parts, key[order], h[order], who[order])), _WINDOWS)

    return run


def _window_matcher(part: pa.Table) -> pa.Table:
    """For each bucket the windows that a smaller id of another bucket holds, with that id."""
    hashes = [np.frombuffer(x.as_py(), np.uint64) for x in part.column("hashes")]
    ids = [np.frombuffer(x.as_py(), np.int64) for x in part.column("ids")]
    h, who = np.concatenate(hashes), np.concatenate(ids)
    order = np.lexsort((who, h))
    h, who = h[order], who[order]
    first = np.r_[True, h[1:] != h[:-1]]
    h, who, rows = h[first], who[first], []
    for q, own, mine in zip(part.column("q").to_pylist(), hashes, ids, strict=True):
        least = who[np.searchsorted(h, own)]
        later = least < mine
        if later.any():
            rows.append((q, own[later].tobytes(), least[later].tobytes()))
    return _table(rows, _EARLIER)


def _remover(window: int):
    def run(bucket: pa.Table, earlier: pa.Table) -> pa.Table:
        ids = _ids(bucket)
        bucket = bucket.take(pa.array(np.argsort(ids, kind="stable")))
        ids = np.sort(ids, kind="stable")
        told = np.concatenate([np.zeros(0, np.uint64)] + [
            np.frombuffer(x.as_py(), np.uint64) for x in earlier.column("hashes")])
        by = np.concatenate([np.zeros(0, np.int64)] + [
            np.frombuffer(x.as_py(), np.int64) for x in earlier.column("ids")])
        order = np.argsort(told)
        told, by = told[order], by[order]
        texts, hashes, starts, rows, gone = [], [], [], [], []
        for row, words in _texts(bucket):
            texts.append((row, words))
            begin, h = words.windows(window)
            hashes.append(h)
            starts.append(begin)
            rows.append(row + np.searchsorted(words.first, begin, "right") - 1)
        h, row_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, rows))
        repeat = np.zeros(len(h), bool)
        if len(told):
            at = np.minimum(np.searchsorted(told, h), len(told) - 1)
            repeat = (told[at] == h) & (by[at] < ids[row_of])
        order = np.argsort(h, kind="stable")  # rows are in order of ids, so each run is too
        same = np.r_[False, h[order][1:] == h[order][:-1]] if len(h) else np.zeros(0, bool)
        leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))] if len(h) else order
        again = same & ((ids[row_of[leader]] < ids[row_of[order]])
                        | (np.r_[-1, row_of[order][:-1]] == row_of[order]))
        repeat[order[again]] = True
        at, doc_rows = 0, []
        for (row, words), begin in zip(texts, starts, strict=True):
            cover = np.zeros(len(words.starts) + 1, np.int64)
            hit = begin[repeat[at:at + len(begin)]]
            at += len(begin)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            lost = np.r_[0, np.cumsum(gone)]
            blob = words.data.tobytes()
            for i in range(len(words.counts)):
                a, b = words.first[i], words.first[i + 1]
                n = int(lost[b] - lost[a])
                text = blob[words.starts[a]:words.ends[b - 1]] if b > a else b""
                kept = text.split()
                if n:
                    kept = [w for w, g in zip(kept, gone[a:b].tolist(), strict=True) if not g]
                doc_rows.append((int(b - a), n, b" ".join(kept).decode()))
        counts = list(zip(*doc_rows, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([
            bucket.column("doc_id").combine_chunks(), pa.array(counts[0], pa.int64()),
            pa.array(counts[1], pa.int64()), pa.array(counts[2], pa.string()),
        ], schema=_KEPT)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the text without repeats.

    A word goes if some run of ``window`` words that covers it also starts earlier: in a
    document with a smaller id, or earlier in the same document.  Runs are judged on the
    input.  Words are parted by ASCII white space and joined by one blank in ``kept``.
    Null and empty texts have no words; null ids come after all ids; rows that repeat an
    id do not make each other's words go, as neither id is smaller.  Other columns are not
    read.  Runs are taken as equal if their 64-bit hashes are; the partition takes bits of
    the same hash.  Different runs share one by chance alone, about ``n * n / 2**65`` pairs among
    ``n`` distinct runs.  An empty table gives an empty one.
    """
    block = window // 2
    if window < 2:
        raise ValueError("a window has two words or more")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    dealt = docs.select(
        F.pmod(F.xxhash64(doc_id, text), F.lit(parts)).cast("int").alias("q"),
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
    )
    sent = dealt.groupBy("q").applyInArrow(_block_sender(block, parts), _ddl(_BLOCKS))
    hits = written(sent.groupBy("part").applyInArrow(_block_matcher, _ddl(_HITS)))
    near = dealt.groupBy("q").cogroup(hits.groupBy("q")).applyInArrow(
        _window_sender(window, block, parts), _ddl(_WINDOWS))
    earlier = written(near.groupBy("part").applyInArrow(_window_matcher, _ddl(_EARLIER)))
    return dealt.groupBy("q").cogroup(earlier.groupBy("q")).applyInArrow(_remover(window), _ddl(_KEPT))
