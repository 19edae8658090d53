"""Building the feature table, training, cross-validation and parameter search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.param import Param
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.functions.text import dataset_clean, single_line
from shellsieve.operators.evaluation import add_folds, add_metrics, confusion, f_beta, summarise
from shellsieve.operators.features import add_features
from shellsieve.operators.results import top
from shellsieve.operators.scoring import LEAF_SHARE, VECTOR, assembler
from shellsieve.plans.bagging import fit_subsampled
from shellsieve.plans.forest_table import as_model, cut, drop_nodes, node_table, prune, settings_cells
from shellsieve.plans.grouping import (
    FITS, NUMBER, Groups, group_rows, grow_drawn, grow_grouped, instances, nodes_of_rows, with_draws)
from shellsieve.session import release, settle
from shellsieve.vocabulary import FEATURE_COLUMNS, KEYWORDS

LABEL = "malicious"
BALANCED = "balanced"
#: balanced within each tree's own bootstrap
SUBSAMPLE = "balanced_subsample"
#: rows from which commands are dealt out anew before their texts are read, and parts per core
SPREAD_ROWS, SPREAD_PARTS = 20_000, 3


@dataclass(frozen=True)
class ForestParams:
    """Settings of the forest; the defaults are those of the final model but for the criterion.

    ``criterion="gini"`` grows trees on the 0/1 label by variance, which is half of Gini's
    measure: a leaf's value is its weighted share of class 1 and leaves that differ in it
    stay apart, so the forest's probability is the mean share of the trees as grown.
    ``"entropy"`` uses Spark's classifier, which merges sibling leaves that predict the same
    class and so blurs probabilities; Spark has no unmerged entropy.

    ``class_weight`` is the weight of class 1 (class 0 weighs 1), ``"balanced"``, or
    ``"balanced_subsample"``: balanced within each tree's own bootstrap, which is then drawn by
    the hash of a row's id (see ``plans.bagging``).  ``min_split`` is the smallest node that
    may be split; Spark has no such setting, so smaller nodes are closed on the fitted node
    table (see ``plans.forest_table``).  4 of the 23 features are tried per split, which is
    what both root and logarithm round down to.
    """

    trees: int = 55
    depth: int = 30
    criterion: str = "gini"
    min_leaf: int = 1
    min_split: int = 5
    min_gain: float = 0.0
    features_per_split: str = "4"
    class_weight: float | str = 7.0
    bootstrap: bool = True
    bins: int = 128
    seed: int = 42
    node_memory_mb: int = 512


# --- fixed values: the full parameter grid -----------------------------------------

FULL_GRID: dict[str, tuple] = {
    "trees": (50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 70, 80, 100),
    "class_weight": (5.0, 7.0, 10.0, BALANCED),
    "criterion": ("entropy", "gini"),
    # An unlimited depth is Spark's limit, 30, and so falls together with it.
    "depth": (25, 27, 30),
    "min_leaf": (1, 2),
}
#: What ``plans.search`` tries: in addition the smallest node for a split, and weights per bootstrap.
FULL_SEARCH: dict[str, tuple] = FULL_GRID | {
    "class_weight": (5.0, 7.0, 10.0, SUBSAMPLE),
    "min_split": (2, 3, 5),
}


def spread(commands: DataFrame) -> DataFrame:
    """The same rows in even parts, three per core, of at least 10,000 rows; few rows stay as they are.

    A file is read by as many tasks as it has row groups, and some writers make one of
    millions of rows.  Work on texts costs far more than their exchange.  The rows are counted
    first, which for Parquet is a look at the footers.
    """
    rows = commands.count()
    if rows < SPREAD_ROWS:
        return commands
    cores = commands.sparkSession.sparkContext.defaultParallelism
    return commands.repartition(min(2 * rows // SPREAD_ROWS, SPREAD_PARTS * cores))


def build_dataset(
    labelled: DataFrame,
    prepare: str = "dataset",
    keywords: Mapping[str, Sequence[str]] = KEYWORDS,
) -> DataFrame:
    """Feature table of labelled commands: features, ``malicious``, ``command``.

    ``prepare="scan"`` cleans the text as a scan does (one line) instead of as the
    training table does (control characters out).  Texts stay whole either way.  Columns
    other than the command and its label, such as an id, are kept at the end.  Rows of a
    large table are spread first.
    """
    clean = {"dataset": dataset_clean, "scan": single_line}[prepare]
    labelled = spread(labelled)
    others = [c for c in labelled.columns if c not in (LABEL, "command")]
    featured = add_features(
        labelled.withColumn("command", clean(F.coalesce(F.col("command"), F.lit("")))),
        "command", keywords,
    )
    return featured.select(*FEATURE_COLUMNS, LABEL, "command", *others)


def model_input(features: DataFrame) -> DataFrame:
    """Numeric columns only: nulls are 0, features double, the label an integer."""
    others = [c for c in features.columns if c not in (*FEATURE_COLUMNS, LABEL, "command")]
    return features.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURE_COLUMNS],
        F.col(LABEL).cast("int").alias(LABEL),
        *others,
    )


def weight_column(weight: float | str) -> str:
    return f"weight_{weight:g}" if isinstance(weight, (int, float)) else f"weight_{weight}"


def add_weights(df: DataFrame, weights: Sequence[float | str]) -> DataFrame:
    """One weight column per choice of class weight.

    The balanced weight of a class is rows / (2 * rows of the class); the table of
    class sizes that is joined has two rows.
    """
    columns = {
        weight_column(w): F.when(F.col(LABEL) == 1, float(w)).otherwise(1.0)
        for w in weights if w not in (BALANCED, SUBSAMPLE)
    }
    df = df.withColumns(columns) if columns else df
    if BALANCED not in weights:
        return df
    ones, rows = F.count_if(F.col(LABEL) == 1), F.count(F.lit(1))
    per_class = [
        F.struct(
            F.lit(label).alias("__class"),
            F.try_divide(rows, 2 * count).alias(weight_column(BALANCED)),
        )
        for label, count in ((1, ones), (0, rows - ones))
    ]
    balanced = df.agg(F.array(*per_class).alias("__classes")).select(F.inline("__classes"))
    return df.join(F.broadcast(balanced), F.col(LABEL) == F.col("__class"), "left").drop("__class")


def forest(params: ForestParams = ForestParams()) -> RandomForestRegressor | RandomForestClassifier:
    """The tree grower alone; see :func:`forest_pipeline` for what is fitted and stored."""
    shared = dict(
        featuresCol=VECTOR, labelCol=LABEL, weightCol=weight_column(params.class_weight),
        numTrees=params.trees, maxDepth=params.depth,
        minInstancesPerNode=params.min_leaf, minInfoGain=params.min_gain,
        featureSubsetStrategy=params.features_per_split, bootstrap=params.bootstrap,
        maxBins=params.bins, seed=params.seed, maxMemoryInMB=params.node_memory_mb,
    )
    if params.criterion == "gini":
        return RandomForestRegressor(predictionCol=LEAF_SHARE, impurity="variance", **shared)
    return RandomForestClassifier(impurity=params.criterion, **shared)


def forest_pipeline(params: ForestParams = ForestParams()) -> Pipeline:
    """Assembler, trees and, for leaf shares, the class at one half: what a scan can load."""
    grower = forest(params)
    stages = [assembler(), grower]
    if isinstance(grower, RandomForestRegressor):
        half = [float("-inf"), 0.5, float("inf")]
        stages.append(Bucketizer(splits=half, inputCol=LEAF_SHARE, outputCol="prediction"))
    return Pipeline(stages=stages)


def add_vector(table: DataFrame) -> DataFrame:
    """Model input with the vector that a forest reads, for a table that is written.

    A fit passes over its rows three or four times before it keeps them; with the vector
    stored, the passes read three columns and do not assemble 23 each time.  The assembler
    stores the non-zero features alone where that is shorter, as it is where few flags are set.
    """
    return assembler().setHandleInvalid("keep").transform(table)


def fit_pipeline(table: DataFrame, params: ForestParams = ForestParams()) -> PipelineModel:
    """:func:`forest_pipeline` fitted; a vector that ``table`` has is not assembled again."""
    pipeline = forest_pipeline(params)
    if VECTOR not in table.columns:
        return pipeline.fit(table)
    first, *others = pipeline.getStages()
    return with_assembler(first, Pipeline(stages=others).fit(table))


def with_assembler(first: VectorAssembler, fitted: PipelineModel) -> PipelineModel:
    return PipelineModel([first, *fitted.stages])


def predictions(model: PipelineModel, table: DataFrame) -> DataFrame:
    """``table`` scored, by its own vector if it has one."""
    stages = [s for s in model.stages if not (isinstance(s, VectorAssembler) and VECTOR in table.columns)]
    return PipelineModel(stages).transform(table)


def fit_table(table: DataFrame, params: ForestParams, id_column: str | None = None) -> PipelineModel:
    """Fit on a written table that has the weight column of ``params``.

    Many rows are grouped first (see ``plans.grouping``) where groups are much fewer.
    """
    if params.class_weight == SUBSAMPLE:
        if id_column is None:
            raise ValueError("bootstraps are drawn by a row's id: name its column")
        single = replace(params, trees=1, bootstrap=False)
        read = [VECTOR] if VECTOR in table.columns else FEATURE_COLUMNS
        model = fit_subsampled(
            table.select(id_column, *read, LABEL), id_column, LABEL, params.trees, params.seed, weight_column(SUBSAMPLE),
            lambda rows, seed: fit_pipeline(rows, replace(single, seed=seed)))
    else:
        weight = weight_column(params.class_weight)
        groups = group_rows(table, LABEL, [weight], params.bins)
        if groups is not None:
            try:
                return fit_groups(groups, params)
            finally:
                release(groups.table)
        model = fit_pipeline(table, params)
    if params.min_split <= 2:
        return model
    nodes = node_table(model)
    try:
        return as_model(prune(nodes, params.min_split), model)
    finally:
        drop_nodes(nodes)


def fit_groups(groups: Groups, params: ForestParams) -> PipelineModel:
    """The forest of ``params`` over the rows that the groups stand for."""
    plain = replace(params, bootstrap=False)
    nodes, like = grow_grouped(
        groups, LABEL, weight_column(params.class_weight), params.trees, params.bootstrap, params.min_leaf, params.seed,
        lambda rows, trees, seed: fit_pipeline(rows, replace(plain, trees=trees, seed=seed)))
    try:
        return as_model(prune(nodes, params.min_split) if params.min_split > 2 else nodes, like)
    finally:
        drop_nodes(nodes)


def fit_forest(
    features: DataFrame, params: ForestParams = ForestParams(), id_column: str | None = None
) -> PipelineModel:
    """Fit on all rows of a feature table.

    Growing a forest passes over its input several times before it caches it, so the
    numeric columns are written out first, and deleted when the model is there.
    ``id_column`` is needed for weights per bootstrap alone.
    """
    table = settle(add_vector(model_input(features)))
    try:
        return fit_table(add_weights(table, [params.class_weight]), params, id_column)
    finally:
        release(table)


def labelled_folds(
    labelled: DataFrame, id_column: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """``id_column``, label and fold of labelled commands; texts are not read.

    Store it, or join it to what needs a fold.  ``cross_validate`` and ``grid_search`` deal
    their own folds from the stored feature table, over numbers alone.
    """
    return add_folds(labelled.select(id_column, LABEL), id_column, LABEL, k, seed)


def training_table(
    features: DataFrame,
    id_column: str,
    k: int = 5,
    seed: int = 42,
    weights: Sequence[float | str] = (7.0,),
) -> tuple[DataFrame, list[DataFrame]]:
    """Model input with folds and weights, and the written tables it reads.

    The fits that follow pass over the rows many times; without the cut each pass would
    run the text features again.  Features that already carry a ``fold`` keep it;
    otherwise the rows are numbered here, from the written numbers.
    """
    if id_column not in features.columns:
        raise ValueError(f"the feature table has no column {id_column!r} to deal folds by")
    numbers = model_input(features)
    if "fold" in features.columns:
        tables = [settle(add_vector(numbers))]
    else:
        tables = [settle(numbers)]
        tables.append(settle(add_vector(add_folds(tables[0], id_column, LABEL, k, seed))))
    table = add_weights(tables[-1], weights).select(
        id_column, *FEATURE_COLUMNS, VECTOR, LABEL, "fold", *[weight_column(w) for w in weights if w != SUBSAMPLE]
    )
    return table, tables


def held_out_predictions(
    table: DataFrame, k: int = 5, params: ForestParams = ForestParams(), parallelism: int = 1,
    id_column: str | None = None,
) -> DataFrame:
    """Every row with the prediction of the forest that did not see its fold."""
    def one_fold(fold: int) -> DataFrame:
        model = fit_table(table.filter(F.col("fold") != fold), params, id_column)
        return predictions(model, table.filter(F.col("fold") == fold))

    if parallelism > 1:
        with ThreadPool(min(parallelism, k)) as pool:
            parts = pool.map(inheritable_thread_target(table.sparkSession)(one_fold), range(k))
    else:
        parts = [one_fold(fold) for fold in range(k)]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(
    features: DataFrame,
    id_column: str,
    k: int = 5,
    params: ForestParams = ForestParams(),
    parallelism: int = 1,
) -> DataFrame:
    """Matrix and metrics of every held-out fold, computed now: ``k`` rows."""
    table, written = training_table(features, id_column, k, params.seed, [params.class_weight])
    try:
        metrics = add_metrics(confusion(held_out_predictions(table, k, params, parallelism, id_column)))
        return table.sparkSession.createDataFrame(metrics.collect(), metrics.schema)
    finally:
        for part in written:
            release(part)


def cross_validation_summary(fold_metrics: DataFrame) -> DataFrame:
    return summarise(fold_metrics)


def feature_importance(spark: SparkSession, model) -> DataFrame:
    """Importance of every feature in percent, highest first."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    fitted = next(stage for stage in stages if hasattr(stage, "featureImportances"))
    rows = [
        (name, float(value) * 100)
        for name, value in zip(FEATURE_COLUMNS, fitted.featureImportances.toArray())
    ]
    frame = spark.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), "feature")


def top_features(spark: SparkSession, model, n: int = 10) -> DataFrame:
    return top(feature_importance(spark, model), "importance", n)


# --- parameter search --------------------------------------------------------------

def expand_grid(grid: Mapping[str, Sequence]) -> list[ForestParams]:
    """All combinations of a grid over ``ForestParams`` fields."""
    known = {f.name for f in fields(ForestParams)}
    unknown = set(grid) - known
    if unknown:
        raise ValueError(f"unknown forest parameters: {sorted(unknown)}")
    return [
        replace(ForestParams(), **dict(zip(grid, values))) for values in product(*grid.values())
    ]


def param_maps(
    grower: RandomForestRegressor | RandomForestClassifier, grid: Mapping[str, Sequence]
) -> list[dict[Param, object]]:
    """Spark's form of a grid without ``criterion``, which chooses the grower itself."""
    params = {
        "trees": grower.numTrees,
        "depth": grower.maxDepth,
        "min_leaf": grower.minInstancesPerNode,
        "min_gain": grower.minInfoGain,
        "features_per_split": grower.featureSubsetStrategy,
        "class_weight": grower.weightCol,
        "bootstrap": grower.bootstrap,
        "bins": grower.maxBins,
        "seed": grower.seed,
        "node_memory_mb": grower.maxMemoryInMB,
    }
    builder = ParamGridBuilder()
    for name, values in grid.items():
        choices = [weight_column(v) for v in values] if name == "class_weight" else list(values)
        builder = builder.addGrid(params[name], choices)
    return builder.build()


def f2_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(
        labelCol=LABEL, metricName="fMeasureByLabel", metricLabel=1.0, beta=2.0
    )


def f2_by_size(
    rows: DataFrame, nodes: DataFrame, trees: Sequence[int], depths: Sequence[int], criterion: str, number: str | None = None
) -> dict[tuple[int, int], float]:
    """F2 of a forest's first ``trees`` trees under each depth limit, over labelled ``rows``.

    Rows may be groups of equal rows, of which ``number`` names the size."""
    if criterion == "gini":
        cells = settings_cells(rows, nodes, LABEL, trees, depths, [2], number=number)
    else:
        # Spark's classifier merges leaves, and which ones hangs on the depth.
        cells = reduce(DataFrame.unionByName, [
            settings_cells(rows, cut(nodes, d), LABEL, trees, [d], [2], ties=False, number=number)
            for d in depths])
    return {(r.trees, r.depth): r.f2 for r in cells.select("trees", "depth", f_beta(2.0).alias("f2")).collect()}


def f2_by_depth(
    rows: DataFrame, nodes: DataFrame, trees: int, depths: Sequence[int], criterion: str, number: str | None = None
) -> dict[int, float]:
    """F2 of the whole forest of ``trees`` trees under each depth limit; see :func:`f2_by_size`."""
    return {depth: f2 for (_, depth), f2 in f2_by_size(rows, nodes, [trees], depths, criterion, number).items()}


@dataclass(frozen=True)
class SearchResult:
    #: assembler and forest of the best parameters, fitted again on all rows
    best_model: PipelineModel
    report: DataFrame

    def best(self) -> DataFrame:
        return self.report.orderBy(F.col("f2").desc(), "combination").limit(1)


def grid_search(
    features: DataFrame,
    id_column: str,
    grid: Mapping[str, Sequence] = FULL_GRID,
    k: int = 5,
    parallelism: int = 4,
    seed: int = 42,
) -> SearchResult:
    """Try every combination on the same stratified folds and keep the best mean F2.

    A forest is grown once for all depths of the grid, to the deepest, and cut to the
    others (see ``forest_table``); with a level of all trees within ``node_memory_mb`` these are
    the forests that Spark grows with those depths.

    Many rows are grouped first (see ``plans.grouping``) where groups are much fewer: rows of a fold
    that no split tells apart are then fitted and judged as one, as often as there are of them.
    Borders of bins are quantiles of all rows, whatever their labels; without bootstraps equal rows
    alone are grouped.  Bootstraps are drawn by group and their trees fitted one by one, so that
    the first trees of the largest forest are the smaller ones of the grid.
    """
    expand_grid(grid)
    weights = list(grid.get("class_weight", (ForestParams().class_weight,)))
    criteria = list(grid.get("criterion", (ForestParams().criterion,)))
    rest = {name: values for name, values in grid.items() if name != "criterion"}
    tries = []
    for criterion in criteria:
        grower = forest(ForestParams(seed=seed, class_weight=weights[0], criterion=criterion))
        tries += [(criterion, grower, chosen) for chosen in param_maps(grower, rest)]

    def setting(i: int, name: str):
        _, grower, chosen = tries[i]
        return chosen.get(getattr(grower, name), grower.getOrDefault(name))

    bootstrapped = [i for i in range(len(tries)) if setting(i, "bootstrap")]
    table, written = training_table(features, id_column, k, seed, weights)
    named = [weight_column(w) for w in weights]
    bins = max(setting(i, "maxBins") for i in range(len(tries)))
    groups = group_rows(table, LABEL, ["fold", *named], bins, exact=not bootstrapped)
    number = None if groups is None else NUMBER
    drawn: dict[int, DataFrame] = {}
    if groups is not None:
        written.append(groups.table)
        table = groups.table
        for own in sorted({setting(i, "seed") for i in bootstrapped}):
            most = max(setting(i, "numTrees") for i in bootstrapped)
            drawn[own] = with_draws(groups, LABEL, most, own, ["fold"]).table
            written.append(drawn[own])

    def subset(i: int) -> str:
        """What ``auto`` means to the forest, for trees that are fitted one by one."""
        said = setting(i, "featureSubsetStrategy")
        if said != "auto":
            return said
        return "all" if setting(i, "numTrees") == 1 else "onethird" if tries[i][0] == "gini" else "sqrt"

    # One forest for the tries that differ in their depth alone, or in their number of drawn trees.
    grown: dict[tuple, list[int]] = {}
    for i, (criterion, grower, chosen) in enumerate(tries):
        alone = drawn and setting(i, "bootstrap")
        read_off = (grower.maxDepth, grower.numTrees, grower.featureSubsetStrategy) if alone else (grower.maxDepth,)
        others = tuple((p.name, v) for p, v in chosen.items() if p not in read_off)
        grown.setdefault((criterion, others, subset(i) if alone else None), []).append(i)

    def grow(members: list[int], kept: Column, fits: int) -> list:
        """The models of the largest forest of ``members`` over the rows ``kept``."""
        first = members[0]
        _, grower, chosen = tries[first]
        largest = {**chosen, **{grower.getParam(n): max(setting(i, n) for i in members) for n in ("numTrees", "maxDepth")}}
        least = setting(first, "minInstancesPerNode")
        if groups is None:
            return [grower.fit(table.filter(kept), largest)]
        if not setting(first, "bootstrap"):
            return [grower.fit(instances(table.filter(kept), F.col(NUMBER), named, least), largest)]
        one = {**largest, grower.bootstrap: False, grower.featureSubsetStrategy: subset(first)}
        own = setting(first, "seed")
        return grow_drawn(
            drawn[own].filter(kept), named, largest[grower.numTrees], least, own,
            lambda rows, trees, seed: grower.fit(rows, {**one, grower.numTrees: trees, grower.seed: seed}), fits)

    def judged(job: tuple[list[int], int]) -> list[tuple[int, float]]:
        members, fold = job
        held_out = table.filter(F.col("fold") == fold)
        if held_out.isEmpty():
            raise ValueError(f"The validation data at fold {fold} is empty.")
        models = grow(members, F.col("fold") != fold, max(1, FITS // parallelism))
        nodes = node_table(*[PipelineModel([model]) for model in models])
        sizes = [(setting(i, "numTrees"), setting(i, "maxDepth")) for i in members]
        try:
            scores = f2_by_size(
                held_out, nodes, *[sorted(set(values)) for values in zip(*sizes)], tries[members[0]][0], number)
        finally:
            drop_nodes(nodes)
        return [(i, scores[size]) for i, size in zip(members, sizes)]

    try:
        one = inheritable_thread_target(table.sparkSession)(judged)
        jobs = [(members, fold) for fold in range(k) for members in grown.values()]
        with ThreadPool(min(parallelism, len(jobs))) as pool:
            found = [pair for pairs in pool.map(one, jobs, chunksize=1) for pair in pairs]
        means = [sum(score for j, score in found if j == i) / k for i in range(len(tries))]
        won = means.index(max(means))
        criterion, grower, _ = tries[won]
        first, _, *after = forest_pipeline(ForestParams(criterion=criterion)).getStages()
        models = [PipelineModel([model]) for model in grow([won], F.lit(True), FITS)]
        if drawn and setting(won, "bootstrap"):
            nodes = nodes_of_rows(node_table(*models), groups, LABEL, setting(won, "weightCol"))
            try:
                models = [as_model(nodes, models[0])]
            finally:
                drop_nodes(nodes)
        best = with_assembler(first, PipelineModel([*models[0].stages, *after]))
    finally:
        for part in written:
            release(part)
    rows = [
        (i, mean, {"criterion": criterion, **{p.name: str(v) for p, v in chosen.items()}})
        for i, (mean, (criterion, _, chosen)) in enumerate(zip(means, tries))
    ]
    report = table.sparkSession.createDataFrame(
        rows, "combination int, f2 double, params map<string,string>"
    )
    return SearchResult(best, report.orderBy(F.col("f2").desc(), "combination"))
