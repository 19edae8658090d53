"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.storage import discard, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star step: hang neighbours onto each node's least neighbour."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node of ``edges (u, v)`` but the roots; a root is the least node.

    Large-star and small-star steps alternate until the edges no longer change, each
    round written out, so neither a hub nor a long chain gathers in one task and the
    number of rounds grows with the logarithm of the longest chain.
    """
    edges = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v").distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        after = written(_stars(_stars(edges, small=False), small=True))
        discard(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.select("u", F.col("v").alias("root"))
