"""Spans found in texts: their table form and the digest of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                  ("base", pa.bool_()), ("via", pa.string())])
DDL = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,via:string>>"

Found = tuple[str, int, int, bool, str]


def annotate(docs: DataFrame, find: Callable[[list[str]], list[list[Found]]], text: str, doc_id: str) -> DataFrame:
    """``doc_id`` and ``spans``: what ``find`` returns for the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans = find([t or "" for t in part.column(1).to_pylist()])
                rows = [[dict(zip(SPAN.names, s, strict=True)) for s in own] for own in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows, pa.list_(SPAN))], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, f"doc_id bigint, spans {DDL}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, parted by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def ordered(spans: list[Found], kinds: tuple[str, ...]) -> list[Found]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
