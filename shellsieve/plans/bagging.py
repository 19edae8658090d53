"""Bootstraps drawn by hash, with class weights of their own: ``balanced_subsample``.

Spark draws its bootstraps itself and takes one weight per row, so weights that follow each
tree's own bootstrap are out of its reach.  Here a row's number of draws for a tree is a
function of its id, the tree and the seed: Poisson with mean one, as Spark draws, by the
place of a SHA-256 in the distribution.  Any task can draw it again and gets the same.  Every
tree is fitted on its rows, repeated as often as drawn and weighted by the class sizes
among them, and the trees are united in one model.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.plans.forest_table import as_model, drop_nodes, node_table
from shellsieve.session import release, settle

#: chance of at most 0, 1, 2, ... draws; beyond the last one no double tells chances apart
DRAWS = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(13))
#: hex digits of the hash that place it between 0 and 1
DIGITS = 13


def draws(id_column: str, tree: Column, seed: int) -> Column:
    """How often a row is in the bootstrap of ``tree``; a null id counts as the text ``null``."""
    told = F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("null")), tree.cast("string"), F.lit(str(seed)))
    place = F.conv(F.substring(F.sha2(told, 256), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)
    # The lambda has the hash made once: a filter makes every mention of a column again.
    number = F.transform(F.array(place), lambda p: sum(((p >= chance).cast("int") for chance in DRAWS), F.lit(0)))
    return F.coalesce(F.get(number, F.lit(0)), F.lit(0))


def class_sizes(table: DataFrame, id_column: str, label: str, trees: int, seed: int) -> DataFrame:
    """``tree``, ``n0`` and ``n1`` (rows of each class in its bootstrap) and their weights.

    The weight of a class is rows / (2 * rows of the class), null if the bootstrap has none
    of it.  One pass for all trees, summed before the exchange.
    """
    if "__draws" not in table.columns:
        table = all_draws(table, id_column, trees, seed)
    drawn = table.select(label, F.posexplode("__draws").alias("tree", "n")).withColumn("n", F.col("n").cast("long"))
    sizes = drawn.groupBy("tree").agg(*[
        F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
    return sizes.select("tree", "n0", "n1", *[
        F.try_divide(F.col("n0") + F.col("n1"), 2 * F.col(f"n{c}")).alias(f"w{c}") for c in (0, 1)])


def all_draws(table: DataFrame, id_column: str, trees: int, seed: int) -> DataFrame:
    """``table`` with ``__draws``, the draws of every tree: hashes for a table that is written."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draws(id_column, t, seed).cast("tinyint"))
    return table.withColumn("__draws", numbers)


def bootstrap(table: DataFrame, id_column: str, tree: int, seed: int) -> DataFrame:
    """The rows of one tree's bootstrap, each as often as drawn; stored draws are used if there."""
    if "__draws" in table.columns:
        number = F.get("__draws", F.lit(tree)).cast("int")
        return _repeated(table, number).drop("__draws")
    return _repeated(table, draws(id_column, F.lit(tree), seed))


def _repeated(table: DataFrame, number: Column) -> DataFrame:
    return table.withColumn("__n", number).filter("__n > 0").withColumn(
        "__n", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).drop("__n")


def fit_subsampled(
    table: DataFrame, id_column: str, label: str, trees: int, seed: int, weight: str,
    fit_one: Callable[[DataFrame, int], PipelineModel], parallelism: int = 4,
) -> PipelineModel:
    """One model of ``trees`` trees; ``fit_one(rows, seed)`` fits a single one without bootstrap.

    ``weight`` names the weight column that it reads.  A fit passes over its rows several
    times, so the draws of all trees are hashed once and written, with what is read of a row.
    """
    drawn = settle(all_draws(table, id_column, trees, seed))
    try:
        return _fit_drawn(drawn, id_column, label, trees, seed, weight, fit_one, parallelism)
    finally:
        release(drawn)


def _fit_drawn(
    table: DataFrame, id_column: str, label: str, trees: int, seed: int, weight: str,
    fit_one: Callable[[DataFrame, int], PipelineModel], parallelism: int,
) -> PipelineModel:
    sizes = {r.tree: (r.w0, r.w1) for r in class_sizes(table, id_column, label, trees, seed).collect()}

    def grow(tree: int) -> PipelineModel:
        w0, w1 = (1.0 if w is None else w for w in sizes[tree])
        rows = bootstrap(table, id_column, tree, seed).withColumn(weight, F.when(F.col(label) == 1, w1).otherwise(w0))
        return fit_one(rows, seed + tree)

    with ThreadPool(min(parallelism, trees)) as pool:
        models = pool.map(inheritable_thread_target(table.sparkSession)(grow), range(trees))
    nodes = node_table(*models)
    try:
        return as_model(nodes, models[0])
    finally:
        drop_nodes(nodes)
