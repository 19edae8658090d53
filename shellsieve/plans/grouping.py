"""Rows that no split can tell apart, grouped: what the forests of a large table are grown from.

A split looks at a row's bin in a feature, of which there are at most ``bins``, and at its label
and weight.  The flags are two values each, so the rows fall into far fewer groups than there
are rows, and a group with its number of rows says all a tree asks of them: sums of weights,
and so gains and leaves, are the same.  The number of times that a bootstrap draws any of ``n``
rows is Poisson with mean ``n``, the sum of the rows' own draws, so bootstraps are drawn by group.

Values of a feature that has many are rounded up to the border of their bin, by quantiles of the
rows given.  Thresholds are taken back to borders, so that rows as they are, not rounded, go the
way that their group went.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.operators.scoring import VECTOR, assembler
from shellsieve.plans.forest_table import drop_nodes, node_table
from shellsieve.session import release, settle
from shellsieve.vocabulary import FEATURE_COLUMNS, FLAG_COLUMNS

#: rows from which grouping is tried, and how many rows a group has to stand for on average
GROUP_ROWS, GROUP_SIZE = 200_000, 8
#: fits that run at a time; each is a row of small jobs
FITS = 12
NUMBER, DRAWS = "__rows", "__draws"


@dataclass(frozen=True)
class Groups:
    """``table``, written: features, their vector, label, weights, ``__rows`` and perhaps ``__draws``."""

    table: DataFrame
    #: borders of the bins of the features that were rounded, ascending
    borders: dict[str, list[float]]


def bin_borders(rows: DataFrame, bins: int) -> dict[str, list[float]] | None:
    """Quantiles of the features with many more values than bins; None if a value is not finite.

    Spark finds all splits of a feature with few values by itself.
    """
    columns = [c for c in FEATURE_COLUMNS if c not in FLAG_COLUMNS]
    shares = [(i + 1) / bins for i in range(bins)]
    found = rows.agg(*[
        F.struct(F.approx_count_distinct(c).alias("values"), F.percentile_approx(c, shares, 10_000).alias("at")).alias(c)
        for c in columns]).first()
    many = {c: sorted(set(found[c]["at"])) for c in columns if found[c]["values"] > 2 * bins}
    return many if all(math.isfinite(b) for at in many.values() for b in at) else None


def rounded_up(rows: DataFrame, borders: dict[str, list[float]]) -> DataFrame:
    """Every value replaced by the smallest border that is no smaller."""
    for c, at in borders.items():
        # Spark's buckets are closed below; those of the negated values are closed above.
        splits = [-math.inf, *[-b for b in reversed(at)], math.inf]
        bucket = Bucketizer(splits=splits, inputCol="__negated", outputCol="__bucket", handleInvalid="error")
        ends = F.array(*[F.lit(b) for b in (at[-1], *reversed(at))])
        rows = bucket.transform(rows.withColumn("__negated", -F.col(c))).withColumn(
            c, F.get(ends, F.col("__bucket").cast("int"))).drop("__negated", "__bucket")
    return rows


def group_rows(rows: DataFrame, label: str, others: Sequence[str], bins: int, exact: bool = False) -> Groups | None:
    """The groups of a written table's rows; None for few rows, or rows that hardly meet.

    ``others`` are further columns that rows of a group share: weights, folds.  ``exact`` asks
    for groups whose rows have the very same values, and gives None where some must be rounded.
    """
    number = rows.count()
    if number < GROUP_ROWS:
        return None
    borders = bin_borders(rows, bins)
    if borders is None or (exact and borders):
        return None
    grouped = rounded_up(rows, borders).groupBy(*FEATURE_COLUMNS, label, *others).agg(F.count(F.lit(1)).alias(NUMBER))
    table = settle(assembler().setHandleInvalid("keep").transform(grouped))
    if table.count() * GROUP_SIZE > number:
        release(table)
        return None
    return Groups(table, borders)


def _drawing(trees: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Draws of every tree for each group, by a generator of the group's own."""
        for batch in batches:
            keys, numbers = (batch.column(c).to_numpy() for c in ("__key", "__rows"))
            draws = np.empty((len(keys), trees), np.int64)
            for i, (key, number) in enumerate(zip(keys.view(np.uint64).tolist(), numbers.tolist())):
                draws[i] = np.random.default_rng([seed, key]).poisson(number, trees)
            lists = pa.ListArray.from_arrays(
                np.arange(len(keys) + 1, dtype=np.int32) * trees, pa.array(draws.ravel()))
            kept = [n for n in batch.schema.names if n != "__key"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], lists], [*kept, "__draws"])

    return run


def with_draws(groups: Groups, label: str, trees: int, seed: int, others: Sequence[str] = ()) -> Groups:
    """The groups with their number of draws for every tree, written; features are in the vector alone.

    ``others`` are the further columns that tell groups apart, such as folds.
    """
    plain = groups.table.drop(VECTOR)
    keyed = plain.withColumn("__key", F.xxhash64(*FEATURE_COLUMNS, label, *others))
    schema = f"{', '.join(f'`{n}` {kind}' for n, kind in plain.dtypes)}, {DRAWS} array<bigint>"
    drawn = keyed.mapInArrow(_drawing(trees, seed), schema)
    return Groups(settle(assembler().setHandleInvalid("keep").transform(drawn).drop(*FEATURE_COLUMNS)), groups.borders)


def instances(groups: DataFrame, number: Column, weights: Sequence[str], min_leaf: int) -> DataFrame:
    """Groups of ``number`` rows as rows to fit: their weights hold the number.

    A fit counts rows for ``min_leaf`` alone: a group counts as often as matters to it.
    """
    counted = groups.withColumn("__n", number).filter("__n > 0")
    times = F.least("__n", F.lit(min_leaf)).cast("int")
    weighed = counted.withColumns({w: F.col(w) * F.col("__n") / times for w in weights})
    if min_leaf > 1:
        weighed = weighed.withColumn("__n", F.explode(F.array_repeat(F.lit(0), times)))
    return weighed.drop("__n")


def class_weights(groups: Groups, label: str, weight: str) -> dict[int, float]:
    return {r[0]: r[1] for r in groups.table.groupBy(label).agg(F.first(weight)).collect()}


def nodes_of_rows(nodes: DataFrame, groups: Groups, label: str, weight: str) -> DataFrame:
    """Nodes grown from groups as nodes over rows, written: thresholds at borders, ``rows`` by weight."""
    threshold = F.col("threshold")
    for c, at in groups.borders.items():
        below = F.array_max(F.filter(F.array(*map(F.lit, at)), lambda b: b <= F.col("threshold")))
        threshold = F.when(F.col("feature") == FEATURE_COLUMNS.index(c), below).otherwise(threshold)
    of = class_weights(groups, label, weight)
    ones, others = (F.col("weight") * share / of.get(y, 1.0) for y, share in ((1, F.col("share")), (0, 1 - F.col("share"))))
    try:
        return settle(nodes.withColumns({"threshold": threshold, "rows": F.round(ones + others).cast("bigint")}))
    finally:
        drop_nodes(nodes)


def grow_drawn(
    drawn: DataFrame, weights: Sequence[str], trees: int, min_leaf: int, seed: int,
    fit: Callable[[DataFrame, int, int], PipelineModel], parallelism: int = FITS,
) -> list[PipelineModel]:
    """Trees fitted one by one on groups with draws, each on the rows that its own bootstrap has.

    The first trees of a larger forest are the smaller forest.
    """
    def grow(tree: int) -> PipelineModel:
        return fit(instances(drawn, F.get(DRAWS, F.lit(tree)), weights, min_leaf), 1, seed + tree)

    with ThreadPool(min(parallelism, trees)) as pool:
        return pool.map(inheritable_thread_target(drawn.sparkSession)(grow), range(trees), chunksize=1)


def grow_grouped(
    groups: Groups, label: str, weight: str, trees: int, bootstrap: bool, min_leaf: int, seed: int,
    fit: Callable[[DataFrame, int, int], PipelineModel],
) -> tuple[DataFrame, PipelineModel]:
    """The nodes of a forest over all rows of the groups, and a model like it.

    ``fit(rows, trees, seed)`` fits trees without bootstrap.  Spark takes one weight per row,
    so trees with a bootstrap of their own are fitted one by one and united.
    """
    if not bootstrap:
        models = [fit(instances(groups.table, F.col(NUMBER), [weight], min_leaf), trees, seed)]
        return nodes_of_rows(node_table(*models), groups, label, weight), models[0]
    drawn = with_draws(groups, label, trees, seed)
    try:
        models = grow_drawn(drawn.table, [weight], trees, min_leaf, seed, fit)
    finally:
        release(drawn.table)
    return nodes_of_rows(node_table(*models), groups, label, weight), models[0]
