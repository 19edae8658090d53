"""Toxicity of texts, by subword-bag embeddings under a linear softmax.

A misspelt word shares most of its character n-grams with the word it stems from, and so
its vector.  See :mod:`shellsieve.llm.classifier` for the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.classifier import SubwordClassifier, train
from shellsieve.llm.tokens import buffers

TRAINING_ROWS = 4000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no training may see: a fifth of the ids, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> SubwordClassifier:
    """A model from ``labels (doc_id, toxic)`` outside the held-out fifth.

    Null labels and ids count as unlabelled; an id with several labels is toxic if any
    says so.  At most ``rows`` labelled documents are used.
    """
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
        .filter("label IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    return train(docs, known, 2, rows)


def _scored(docs: DataFrame, model: SubwordClassifier, text: str, keep: tuple[str, ...]) -> DataFrame:
    at = keep.index(text) if text in keep else len(keep)
    chosen = docs.select(*keep, *([] if text in keep else [F.col(text).alias("__text")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(*buffers(batch.column(at)))[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p)], [*keep, "__score"])

    kinds = [f"`{n}` {t}" for n, t in chosen.dtypes[: len(keep)]]
    return chosen.mapInArrow(run, ", ".join([*kinds, "__score double"]))


def score_toxicity(docs: DataFrame, model: SubwordClassifier, text: str = "text",
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Whole texts are scored; null and empty texts, and texts without words, have the score
    of the training prior.  Rows are independent: repeated rows score alike.  Other columns
    are not read; an empty table gives an empty one.
    """
    scored = _scored(docs, model, text, keep)
    return scored.select(*keep, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: SubwordClassifier, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns, whatever their names."""
    return _scored(docs, model, text, tuple(docs.columns)).filter("__score < 0.5").drop("__score")
