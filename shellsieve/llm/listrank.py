"""Places in sorted order and in linked lists, over all partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.llm.storage import discard, written

#: A list of at most so many elements is ranked in one task; a longer one is first contracted.
MOST = 1 << 16


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``: 0, 1, 2, ... in the order of the named columns (nulls first).

    Rows are dealt by ranges and sorted there, equal rows by where they were read, so that no
    key and no group of equal rows has to fit in one task.  What stands before a partition is a
    sum of row counts, one row per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = df.withColumn("__tie", F.monotonically_increasing_id())
    table = written(
        told.repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
        .withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    )
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return table.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + inside).alias("place"))


def _coin(element: str, turn: int, head: int) -> Column:
    tossed = F.xxhash64(F.col(element), F.lit(turn)).bitwiseAND(F.lit(1)) == 1
    return F.coalesce(tossed & (F.col(element) != head), F.lit(False))


def _walk(weights: tuple[str, ...], head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        arcs = table.column(0).to_numpy()
        follows = dict(zip(arcs.tolist(), table.column(1).to_pylist(), strict=True))
        at = {arc: i for i, arc in enumerate(arcs.tolist())}
        order, arc = [], head
        while arc is not None:
            order.append(at[arc])
            arc = follows[arc]
        order = np.array(order)
        sums = []
        for name in weights:
            own = table.column(name).to_numpy()[order]
            sums.append(pa.array(np.cumsum(own) - own))
        yield pa.RecordBatch.from_arrays([pa.array(arcs[order]), *sums], ["arc", *weights])

    return run


def list_ranks(links: DataFrame, head: int, weights: tuple[str, ...], most: int = MOST) -> DataFrame:
    """``arc`` and, for each of ``weights``, the sum over all elements before it in the list.

    ``links`` has ``arc``, ``next`` (null at the end) and whole-number weights; a weight of
    one gives the element's place.  While more than ``most`` elements are left, each tosses a
    coin (a hash of element and round); an element with one, whose predecessor has zero, is
    spliced out, about a quarter in a round, and its predecessor takes over link and weight.
    The rest is walked in one task of bounded size, then the elements come back, round by
    round, from their predecessors.  Rounds grow with the logarithm, rows read with the size;
    joins have one row per key on both sides.
    """
    current, spliced, turn = written(links.select("arc", "next", *weights)), [], 0
    n = current.count()
    while n > most:
        after = current.select(F.col("arc").alias("b_arc"), F.col("next").alias("b_next"),
                               *[F.col(w).alias(f"b_{w}") for w in weights])
        one, next_one = _coin("arc", turn, head), _coin("next", turn, head)
        merge = ~one & next_one
        own = F.struct("arc", F.when(merge, F.col("b_next")).otherwise(F.col("next")).alias("next"), *[
            (F.col(w) + F.when(merge, F.col(f"b_{w}")).otherwise(0)).alias(w) for w in weights])
        next_own = F.struct(F.col("b_arc").alias("arc"), F.col("b_next").alias("next"),
                            *[F.col(f"b_{w}").alias(w) for w in weights])
        out = F.struct(F.col("next").alias("arc"), F.col("arc").alias("behind"), *weights)
        step = written(current.join(after, current["next"] == after["b_arc"], "left").select(
            F.when(~one, own).when(next_one, next_own).alias("kept"), F.when(merge, out).alias("out")))
        current = step.filter("kept IS NOT NULL").select("kept.*")
        spliced.append(step)
        n, turn = current.count(), turn + 1
    kind = ", ".join(["arc bigint", *[f"{w} bigint" for w in weights]])
    known = written(current.repartition(1).mapInArrow(_walk(weights, head), kind))
    for step in reversed(spliced):
        ahead = known.select(F.col("arc").alias("behind"), *[F.col(w).alias(f"b_{w}") for w in weights])
        back = step.filter("out IS NOT NULL").select("out.*").join(ahead, "behind")
        more = written(known.unionByName(back.select("arc", *[(F.col(w) + F.col(f"b_{w}")).alias(w) for w in weights])))
        discard(known)
        discard(step)
        known = more
    return known
