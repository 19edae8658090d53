"""A parameter search that grows few forests and keeps what it has found.

Trees are grown without a smallest node size, to the largest number and depth of the grid, once
per class weight, criterion, leaf size and fold; every other setting is read off that forest by
:func:`forest_table.settings_cells`.  The counts of a forest go into a ledger as soon as they are
there, a folder of its own per fit, so writers do not meet and a fit that is run again
replaces its rows.  A search that starts asks the ledger first and grows only what is missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.operators.evaluation import f_beta
from shellsieve.plans import train
from shellsieve.plans.forest_table import drop_nodes, node_table, settings_cells
from shellsieve.session import release

#: settings that need a forest of their own, and those that one forest answers
GROWN, READ_OFF = ("class_weight", "criterion", "min_leaf"), ("trees", "depth", "min_split")
LEDGER = (
    "data string, class_weight string, criterion string, min_leaf int, fold int, folds int, seed int, grown_trees int, "
    "grown_depth int, trees int, depth int, min_split int, tn bigint, fp bigint, fn bigint, tp bigint"
)


@dataclass(frozen=True)
class Fit:
    """One forest of the search; ``params`` has the largest values of the grid."""

    params: train.ForestParams
    fold: int
    folds: int
    data: str

    def key(self) -> dict:
        p = self.params
        return {"data": self.data, "class_weight": str(p.class_weight), "criterion": p.criterion, "min_leaf": p.min_leaf,
                "fold": self.fold, "folds": self.folds, "seed": p.seed, "grown_trees": p.trees, "grown_depth": p.depth}

    def folder(self) -> str:
        return "fit=" + hashlib.sha256(repr(sorted(self.key().items())).encode()).hexdigest()[:24]


@dataclass(frozen=True)
class Found:
    best: train.ForestParams
    best_model: PipelineModel
    #: every setting with its mean F2 over the folds, the best first
    report: DataFrame
    #: forests grown by this run; the others were in the ledger
    grown: int


def fingerprint(table: DataFrame) -> str:
    """Rows and a sum of row hashes: tells the ledgers of different data apart."""
    rows, total = table.agg(F.count("*"), F.sum(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)"))).first()
    return f"{rows}:{total}"


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """All counts found so far, none if the folder is new."""
    schema = spark.createDataFrame([], LEDGER).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger)


def settings(grid: Mapping[str, Sequence]) -> dict[str, tuple]:
    """The grid with the final model's value where it names none."""
    unknown = set(grid) - {*GROWN, *READ_OFF}
    if unknown:
        raise ValueError(f"the search has no such parameters: {sorted(unknown)}")
    final = train.ForestParams()
    return {n: tuple(grid.get(n, (getattr(final, n),))) for n in (*GROWN, *READ_OFF)}


def missing(spark: SparkSession, ledger: str, fits: Sequence[Fit], grid: Mapping[str, tuple]) -> list[Fit]:
    """Fits of which the ledger lacks a setting."""
    read_off = list(product(*[grid[n] for n in READ_OFF]))
    kinds = dict(field.split() for field in LEDGER.split(", "))
    names = [*fits[0].key(), *READ_OFF]
    wanted = spark.createDataFrame(
        [(i, *fit.key().values(), *values) for i, fit in enumerate(fits) for values in read_off],
        "fit_no int, " + ", ".join(f"{n} {kinds[n]}" for n in names))
    lacking = wanted.join(ledger_rows(spark, ledger), names, "left_anti").select("fit_no").distinct()
    return [fits[r.fit_no] for r in lacking.orderBy("fit_no").collect()]


def _run(table: DataFrame, id_column: str, fit: Fit, grid: Mapping[str, tuple], ledger: str) -> None:
    model = train.fit_table(table.filter(F.col("fold") != fit.fold), replace(fit.params, min_split=2), id_column)
    nodes = node_table(model)
    try:
        cells = settings_cells(
            table.filter(F.col("fold") == fit.fold), nodes, train.LABEL, *[grid[n] for n in READ_OFF],
            ties=fit.params.criterion == "gini")
        told = cells.select(*[F.lit(v).alias(n) for n, v in fit.key().items()], *READ_OFF, "tn", "fp", "fn", "tp")
        told.coalesce(1).write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/{fit.folder()}")
    finally:
        drop_nodes(nodes)


def search(
    features: DataFrame, id_column: str, ledger: str, grid: Mapping[str, Sequence] = train.FULL_SEARCH,
    k: int = 5, seed: int = 42, parallelism: int = 2,
) -> Found:
    """Mean F2 of every setting over ``k`` stratified folds, and the best one fitted on all rows.

    ``ledger`` is a folder that outlives the session.  Rows of other data, seeds, folds or
    larger grids stay there and do not count.
    """
    grid = settings(grid)
    spark = features.sparkSession
    weights = [w for w in grid["class_weight"] if w != train.SUBSAMPLE]
    table, written = train.training_table(features, id_column, k, seed, weights)
    try:
        data = fingerprint(table.drop(train.VECTOR, *[train.weight_column(w) for w in weights]))
        base = train.ForestParams(trees=max(grid["trees"]), depth=max(grid["depth"]), seed=seed)
        fits = [Fit(replace(base, **dict(zip(GROWN, values))), fold, k, data)
                for values in product(*[grid[n] for n in GROWN]) for fold in range(k)]
        lacking = missing(spark, ledger, fits, grid)
        one = inheritable_thread_target(spark)(lambda fit: _run(table, id_column, fit, grid, ledger))
        if lacking:
            with ThreadPool(min(parallelism, len(lacking))) as pool:
                pool.map(one, lacking, chunksize=1)
    finally:
        for part in written:
            release(part)
    own = fits[0].key()
    same = F.lit(True)
    for name in ("data", "folds", "seed", "grown_trees", "grown_depth"):
        same = same & (F.col(name) == own[name])
    wanted = spark.createDataFrame(
        [(*map(str, values[:2]), *values[2:]) for values in product(*grid.values())],
        "class_weight string, criterion string, min_leaf int, trees int, depth int, min_split int")
    report = (
        ledger_rows(spark, ledger).filter(same).join(F.broadcast(wanted), wanted.columns, "left_semi")
        .withColumn("f2", f_beta(2.0)).groupBy(*wanted.columns)
        .agg(F.avg("f2").alias("f2"), F.count("*").cast("int").alias("folds"))
        .orderBy(F.col("f2").desc(), *wanted.columns)
    )
    top = report.first()
    named = next(w for w in grid["class_weight"] if str(w) == top.class_weight)
    best = train.ForestParams(seed=seed, class_weight=named, **{n: top[n] for n in ("criterion", "min_leaf", *READ_OFF)})
    return Found(best, train.fit_forest(features, best, id_column), report, len(lacking))
