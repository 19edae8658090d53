"""A linear softmax over averaged subword embeddings, trained jointly in numpy.

A word is the mean of the vectors of its parts (itself and its character n-grams, hashed
into buckets), a text the mean of its words.  Vectors and softmax are learned together.  As
everything before the softmax is linear, a trained model is one number per bucket and
class, a table of fixed size that scoring looks up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.subwords import SIZES, Subwords
from shellsieve.llm.tokens import buffers, pieces

CAUTION = np.float32(0.003)
GAIN = 50.0  # scales the mean, so that a few words of a long text reach the softmax


def bags(data: np.ndarray, offsets: np.ndarray, buckets: int, sizes: tuple[int, ...]) -> Iterator[tuple]:
    """Distinct buckets and their weights in the mean, per text."""
    for a, b in pieces(offsets):
        parts = Subwords(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], buckets, sizes)
        weight = (1.0 / np.maximum(parts.parts_per_word(), 1))[parts.word]
        text = (np.searchsorted(parts.first, parts.word, "right") - 1).astype(np.int64)
        key = text * buckets + parts.bucket
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, first) if len(first) else weight
        key = key[first]
        cuts = np.searchsorted(key, np.arange(b - a + 1) * buckets)
        for i in range(b - a):
            own = slice(cuts[i], cuts[i + 1])
            yield ((key[own] % buckets).astype(np.int32),
                   (total[own] / max(1, parts.counts[i])).astype(np.float32))


class SubwordClassifier:
    """Trained model: ``table[bucket, class]``, ``bias[class]``; scores texts of a batch."""

    def __init__(self, classes: int, buckets: int = 1 << 18, sizes: tuple[int, ...] = SIZES):
        self.classes, self.buckets, self.sizes = classes, buckets, sizes
        self.table = np.zeros((buckets, classes), np.float32)
        self.bias = np.zeros(classes, np.float32)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int = 8,
            updates: int = 1500, rate: float = 0.3, batch: int = 32, seed: int = 11) -> SubwordClassifier:
        """Adagrad in whole passes until that many updates; a row is buckets and weights.

        ``CAUTION`` keeps steps of parts that are met once or twice small: without it such
        parts are learned by heart.  Steps shrink to nothing towards the end.  Without rows
        all classes but the first share a quarter.
        """
        in_pass, step = max(1, -(-len(rows) // batch)), 0
        passes = -(-updates // in_pass)
        n = np.bincount(labels, minlength=self.classes).astype(float)
        prior = n + np.where(np.arange(self.classes) == 0, 1.5, 0.5 / max(1, self.classes - 1))
        bias = np.log(prior / prior.sum())
        rng = np.random.Generator(np.random.PCG64(seed))
        vectors = (rng.standard_normal((self.buckets, width)) * 0.1).astype(np.float32)
        softmax = (rng.standard_normal((width, self.classes)) * 0.5).astype(np.float32)
        seen_v = np.full((self.buckets, 1), 1e-8, np.float32)
        seen_s, seen_b = np.full(softmax.shape, 1e-8), np.full(self.classes, 1e-8)
        order, one = np.arange(len(rows)), np.eye(self.classes)
        for _ in range(passes if np.count_nonzero(n) > 1 else 0):
            rng.shuffle(order)
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                pace = rate * (1 - step / (passes * in_pass))
                step += 1
                index = np.concatenate([rows[i][0] for i in some])
                value = np.concatenate([rows[i][1] for i in some]).astype(np.float32) * np.float32(GAIN)
                sizes = np.array([len(rows[i][0]) for i in some])
                hidden = np.zeros((len(some), width), np.float32)
                if not len(index):
                    continue
                filled = sizes > 0
                starts = (np.cumsum(sizes) - sizes)[filled]
                hidden[filled] = np.add.reduceat(vectors[index] * value[:, None], starts, axis=0)
                logits = hidden @ softmax + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                gap = (p - one[labels[some]]) / len(some)
                to_softmax, to_bias = hidden.T @ gap, gap.sum(0)
                to_rows = np.repeat((gap @ softmax.T).astype(np.float32), sizes, axis=0) * value[:, None]
                sort = np.argsort(index, kind="stable")
                ranked = index[sort]
                cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
                to_vectors, touched = np.add.reduceat(to_rows[sort], cuts, axis=0), ranked[cuts]
                seen_v[touched] += (to_vectors**2).mean(1, keepdims=True)
                seen_s += to_softmax**2
                seen_b += to_bias**2
                vectors[touched] -= pace * to_vectors / (np.sqrt(seen_v[touched]) + CAUTION)
                softmax -= (pace * to_softmax / np.sqrt(seen_s)).astype(np.float32)
                bias -= pace * to_bias / np.sqrt(seen_b)
        if len(rows):
            met = np.zeros(self.buckets, bool)
            for index, _ in rows:
                met[index] = True
            vectors[~met] = 0  # parts never met say nothing
        else:
            vectors[:] = 0
        self.table = (vectors @ softmax * np.float32(GAIN)).astype(np.float32)
        self.bias = bias.astype(np.float32)
        return self

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Class probabilities of each text; a text without words has those of the bias."""
        out = np.zeros((len(offsets) - 1, self.classes))
        table = self.table
        if self.classes == 2:  # one difference is enough
            table = np.stack([np.zeros(self.buckets, np.float32), table[:, 1] - table[:, 0]], 1)
        for a, b in pieces(offsets):
            parts = Subwords(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], self.buckets, self.sizes)
            if not self.sizes:  # a word is its only part: all classes in one look-up
                sums = np.zeros((len(parts.bucket) + 1, self.classes))
                np.cumsum(table[parts.bucket], axis=0, dtype=np.float64, out=sums[1:])
                out[a:b] = (sums[parts.first[1:]] - sums[parts.first[:-1]]) / np.maximum(parts.counts, 1)[:, None]
                continue
            n = parts.parts_per_word()
            for c in range(1 if self.classes == 2 else 0, self.classes):
                word = np.bincount(parts.word, weights=table[:, c][parts.bucket], minlength=len(n)) / np.maximum(n, 1)
                sums = np.r_[0.0, np.cumsum(word)]
                out[a:b, c] = (sums[parts.first[1:]] - sums[parts.first[:-1]]) / np.maximum(parts.counts, 1)
        out += [0, self.bias[1] - self.bias[0]] if self.classes == 2 else self.bias
        p = np.exp(out - out.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, classes: int, rows: int, text: str = "text",
          doc_id: str = "doc_id", **shape) -> SubwordClassifier:
    """Fit on at most ``rows`` labelled documents, those whose hashed ids come first.

    ``labels`` has ``doc_id`` and ``label`` (0 to ``classes - 1``), one row per id.
    """
    model = SubwordClassifier(classes, **shape)
    sample = labels.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(rows)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(sample), "doc_id").select("label", "text")  # at most `rows` ids
    buckets, sizes = model.buckets, model.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i.tobytes(), v.astype(np.float16).tobytes()) for i, v in bags(*buffers(batch.column(1)), buckets, sizes)]
            columns = list(zip(*own, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
                ["label", "index", "value"])

    found, targets = [], []
    # Bounded by `rows`; a repeated id would exceed it, so the rest of such rows is left out.
    for row in chosen.mapInArrow(run, "label int, index binary, value binary").toLocalIterator():
        if len(found) < rows:
            found.append((np.frombuffer(row["index"], np.int32), np.frombuffer(row["value"], np.float16)))
            targets.append(row["label"])
    return model.fit(found, np.array(targets, np.int64))
