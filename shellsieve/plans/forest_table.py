"""A fitted forest as a table of nodes: scoring by walks, importance, pruning, writing back.

The table has one row per node: ``tree``, ``node`` (numbered from the root, parents first),
``parent`` (-1 for the root), ``depth``, ``left`` and ``right`` (-1 in a leaf), ``feature``
and ``threshold`` of the split (rows at or below it go left), ``rows`` (of the tree's
bootstrap, unweighted), ``weight``, ``share`` (weighted share of class 1), ``gain``,
``impurity`` and ``stats``.  It is as large as the model, which Spark's own form holds on
the driver and on every executor; walks hold it there in the same way, as arrays.

Spark grows the trees; what it has no setting for is done on the table.  Growing is greedy, so
a node's split does not hang on limits below it: a tree grown without a smallest node size is,
once the nodes below small ones are taken out, the tree grown with it.  One fit
therefore answers for every smaller number of trees, every lower depth and every node size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shellsieve.operators.scoring import LEAF_SHARE
from shellsieve.session import release, release_path, work_folder
from shellsieve.vocabulary import FEATURE_COLUMNS

NODES = (
    "tree int, node int, parent int, depth int, left int, right int, feature int, threshold double, "
    "rows bigint, weight double, share double, gain double, impurity double, prediction double, stats array<double>"
)
#: share of class 1 from which a row is class 1; a classifier gives ties to class 0
HALF = 0.5
#: models that are stored at a time
SAVES = 12
#: rows that are walked at once
CHUNK = 8192


def _grower(model: PipelineModel) -> tuple[int, RandomForestRegressionModel | RandomForestClassificationModel]:
    return next((i, s) for i, s in enumerate(model.stages) if hasattr(s, "getNumTrees"))


# Functions that run in workers are made by a function: they travel by value, so that workers
# need numpy and Arrow but not this package.

def _placing():
    def place(tree):
        """Parents and depths of one tree; children have larger numbers than their parent."""
        tree = tree.sort_values("node").reset_index(drop=True)
        n = len(tree)
        parent, depth = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        left, right = tree["left"].to_numpy(), tree["right"].to_numpy()
        for node in np.flatnonzero(left >= 0):
            parent[[left[node], right[node]]] = node
        for node in range(1, n):
            depth[node] = depth[parent[node]] + 1
        return tree.assign(parent=parent, depth=depth)

    return place


def node_table(*models: PipelineModel) -> DataFrame:
    """The nodes of a fitted forest, read from where the model is stored for it.

    Several models are united into one forest; their trees are numbered on, in the order
    given.  :func:`drop_nodes` deletes what was stored when nothing reads the table any more.
    """
    spark = SparkSession.active()
    start = f"{work_folder(spark)}/forests/{uuid.uuid4().hex}"
    growers = [_grower(model)[1] for model in models]

    def save(i: int) -> None:
        growers[i].write().save(f"{start}/{i}")

    with ThreadPool(min(SAVES, len(growers))) as pool:
        pool.map(inheritable_thread_target(spark)(save), range(len(growers)), chunksize=1)
    parts, before = [], 0
    for i, grower in enumerate(growers):
        # Every model's nodes carry their stored number as a partition column of one table.
        parts.append((i, before))
        before += grower.getNumTrees
    data, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    if isinstance(grower, RandomForestRegressionModel):
        weight, share = stats[0], data["prediction"]
    else:
        weight = F.aggregate(stats, F.lit(0.0), lambda a, s: a + s)
        share = stats[1] / weight
    stored = spark.read.parquet(*[f"{start}/{i}/data" for i, _ in parts])
    model_no = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/data/[^/]*$", 1).cast("int")
    offsets = F.array(*[F.lit(n) for _, n in parts])
    flat = stored.select(
        (F.col("treeID") + offsets[model_no]).cast("int").alias("tree"), data["id"].alias("node"),
        F.lit(-1).alias("parent"), F.lit(0).alias("depth"),
        data["leftChild"].alias("left"), data["rightChild"].alias("right"),
        data["split"]["featureIndex"].alias("feature"), F.get(data["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        data["rawCount"].alias("rows"), weight.alias("weight"), share.alias("share"), data["gain"].alias("gain"),
        data["impurity"].alias("impurity"), data["prediction"].alias("prediction"), stats.alias("stats"))
    # A tree is a part of a model that one machine holds whole.
    table = flat.groupBy("tree").applyInPandas(_placing(), NODES)
    table._settled_path = start
    return table


def drop_nodes(table: DataFrame) -> None:
    release(table)


def prune(nodes: DataFrame, min_split: int = 2, depth: int | None = None, trees: int | None = None) -> DataFrame:
    """The table as if grown with these limits; node numbers close up again.

    A node with fewer than ``min_split`` rows, or at ``depth``, becomes a leaf; it keeps its
    rows and share.  A child has no more rows than its parent, so a node goes exactly if its
    parent is too small or too deep.  ``trees`` keeps the first ones.
    """
    if trees is not None:
        nodes = nodes.filter(F.col("tree") < trees)
    closed = F.col("rows") < min_split
    if depth is not None:
        closed = closed | (F.col("depth") >= depth)
    marked = nodes.withColumn("closed", closed)
    above = marked.select("tree", F.col("node").alias("parent"), F.col("closed").alias("gone"))
    kept = marked.join(above, ["tree", "parent"], "left").filter(~F.coalesce("gone", F.lit(False)))
    order = Window.partitionBy("tree").orderBy("node")
    numbered = kept.withColumn("new", (F.row_number().over(order) - 1).cast("int"))
    names = numbered.select("tree", "node", "new")

    def renamed(df: DataFrame, column: str) -> DataFrame:
        other = names.select("tree", F.col("node").alias(column), F.col("new").alias(f"new_{column}"))
        return df.join(other, ["tree", column], "left").withColumn(f"new_{column}", F.coalesce(f"new_{column}", F.lit(-1)))

    for column in ("parent", "left", "right"):
        numbered = renamed(numbered, column)
    leaf = F.col("closed") | (F.col("left") < 0)

    def unless_leaf(value: Column, otherwise: Column) -> Column:
        return F.when(~leaf, value).otherwise(otherwise)

    return numbered.select(
        "tree", F.col("new").alias("node"), F.col("new_parent").alias("parent"), "depth",
        unless_leaf(F.col("new_left"), F.lit(-1)).alias("left"), unless_leaf(F.col("new_right"), F.lit(-1)).alias("right"),
        unless_leaf(F.col("feature"), F.lit(-1)).alias("feature"), F.when(~leaf, F.col("threshold")).alias("threshold"),
        "rows", "weight", "share", unless_leaf(F.col("gain"), F.lit(-1.0)).alias("gain"), "impurity", "prediction", "stats")


def _cutting(depth: int):
    def closed(tree):
        """One tree; children have larger numbers than their parent, so leaves come first from behind."""
        tree = tree.sort_values("node").reset_index(drop=True)
        said = tree["prediction"].to_numpy().copy()
        left, right = tree["left"].to_numpy().copy(), tree["right"].to_numpy().copy()
        left[tree["depth"] >= depth] = -1
        for node in np.flatnonzero(left >= 0)[::-1]:
            if left[left[node]] < 0 and left[right[node]] < 0 and said[left[node]] == said[right[node]]:
                left[node] = -1
        return tree.assign(left=left, right=np.where(left < 0, -1, right))

    return closed


def cut(nodes: DataFrame, depth: int) -> DataFrame:
    """A classifier's nodes with its leaves as if grown to ``depth``, for walks.

    Nodes at ``depth`` become leaves, and sibling leaves that predict the same class are merged,
    as Spark does after growing; nodes below a leaf stay in the table and are not reached.
    """
    return nodes.groupBy("tree").applyInPandas(_cutting(depth), NODES)


def importance(nodes: DataFrame) -> DataFrame:
    """``feature`` (its name) and ``importance`` in percent, of every input column.

    A tree's importance of a feature is the gain of its splits, weighed by the rows that
    reach them and divided by the tree's total; the forest's is the mean over the trees.
    """
    gains = nodes.filter("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    per_tree = gains.withColumn("g", F.try_divide("g", F.sum("g").over(Window.partitionBy("tree"))))
    summed = per_tree.groupBy("feature").agg(F.sum("g").alias("g"))
    shares = summed.select("feature", (100 * F.try_divide("g", F.sum("g").over(Window.partitionBy()))).alias("share"))
    names = F.posexplode(F.array(*map(F.lit, FEATURE_COLUMNS))).alias("at", "name")
    every = nodes.sparkSession.range(1).select(names)
    return every.join(shares, F.col("at") == F.col("feature"), "left").select(
        F.col("name").alias("feature"), F.coalesce("share", F.lit(0.0)).alias("importance")
    ).orderBy(F.col("importance").desc(), "feature")


def as_model(nodes: DataFrame, like: PipelineModel) -> PipelineModel:
    """The nodes as a model that Spark scores with, saves and loads; ``like`` gives the rest of it."""
    spark = nodes.sparkSession
    at, grower = _grower(like)
    start = f"{work_folder(spark)}/forests/{uuid.uuid4().hex}"
    old, new = f"{start}-like", f"{start}-made"
    grower.write().save(old)
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(F.col("threshold").isNull(), F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"))
    node = F.struct(
        F.col("node").alias("id"), "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("rows").alias("rawCount"),
        "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{new}/data")
    trees = spark.read.parquet(f"{new}/data").agg(F.max("treeID")).first()[0] + 1
    one = spark.read.parquet(f"{old}/treesMetadata").filter("_1 = 0")
    one.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_1"), "_2", "_3").write.parquet(f"{new}/treesMetadata")
    said = json.loads(spark.read.text(f"{old}/metadata").first()[0])
    said["numTrees"] = said["paramMap"]["numTrees"] = trees
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{new}/metadata")
    made = type(grower).load(new)
    for path in (old, new):
        release_path(spark, path)
    return PipelineModel([made if i == at else stage for i, stage in enumerate(like.stages)])


# --- walks ---------------------------------------------------------------------------

def _arrays(nodes: DataFrame) -> dict[str, np.ndarray]:
    """A node table as arrays, trees one after the other; ``left`` and ``right`` are places in them."""
    columns = ["tree", "node", "left", "right", "feature", "threshold", "rows", "share"]
    table = nodes.select(*columns).toPandas().sort_values(["tree", "node"])
    tree = table["tree"].to_numpy()
    roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    base = np.repeat(roots, np.diff(np.r_[roots, len(tree)]))
    sides = {c: np.where(table[c] < 0, -1, table[c] + base) for c in ("left", "right")}
    return {"roots": roots, **sides, **{c: table[c].to_numpy() for c in ("feature", "threshold", "rows", "share")}}


def _walking(nodes: DataFrame):
    """A function from an Arrow batch to the shares where its rows' walks end."""
    held = nodes.sparkSession.sparkContext.broadcast(_arrays(nodes))

    def walk(batch: pa.RecordBatch, depths: Sequence[int], min_split: int = 2) -> np.ndarray:
        """Under each depth limit, ascending: ``[row, tree, limit]``.  The walk for the last
        limit passes the ends of the others."""
        f = held.value
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURE_COLUMNS], 1)
        out = np.empty((len(x), len(f["roots"]), len(depths)))
        for t, root in enumerate(f["roots"]):
            at, going, level = np.full(len(x), root), np.arange(len(x)), 0
            for d, limit in enumerate(depths):
                while level < limit and len(going):
                    node = at[going]
                    inner = (f["left"][node] >= 0) & (f["rows"][node] >= min_split)
                    going, node = going[inner], node[inner]
                    goes_left = x[going, f["feature"][node]] <= f["threshold"][node]
                    at[going] = np.where(goes_left, f["left"][node], f["right"][node])
                    level += 1
                out[:, t, d] = f["share"][at]
        return out

    return walk


def _inputs(rows: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURE_COLUMNS]


def tree_shares(rows: DataFrame, nodes: DataFrame, id_column: str) -> DataFrame:
    """``id_column`` and ``shares``: the share of class 1 in the leaf of each tree, in tree order."""
    walk = _walking(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                found = walk(batch, [1 << 30])[:, :, 0]
                lists = pa.ListArray.from_arrays(
                    np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_column, "shares"])

    kind = dict(rows.dtypes)[id_column]
    return rows.select(id_column, *_inputs(rows)).mapInArrow(run, f"`{id_column}` {kind}, shares array<double>")


def prefix_shares(shares: Column, counts: Sequence[int]) -> Column:
    """The forest's share for the first ``n`` trees, for each of ``counts``: running means."""
    sums = F.aggregate(
        shares, F.array(F.lit(0.0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    return F.transform(F.array(*map(F.lit, counts)), lambda n: F.element_at(sums, n + 1) / n)


def node_scores(rows: DataFrame, nodes: DataFrame, id_column: str) -> DataFrame:
    """``id_column`` and ``leaf_share``, the mean over all trees: what the model gives."""
    found = tree_shares(rows, nodes, id_column)
    total = F.aggregate("shares", F.lit(0.0), lambda a, s: a + s)
    return found.select(id_column, (total / F.size("shares")).alias(LEAF_SHARE))


def settings_cells(rows: DataFrame, nodes: DataFrame, label: str, trees: Sequence[int], depths: Sequence[int],
                   min_splits: Sequence[int], ties: bool = True, number: str | None = None) -> DataFrame:
    """Confusion cells of every setting over labelled ``rows``, from one walk per node size.

    ``number`` names a column that says how many equal rows a row stands for.

    One row per ``trees``, ``depth`` and ``min_split``, with ``tn``, ``fp``, ``fn`` and ``tp``.
    ``ties`` says whether a share of exactly one half is class 1.  Cells are summed inside a
    task and then over tasks; per-tree shares of a row live in the task alone.
    """
    walk = _walking(nodes)
    limits, counts = sorted(set(depths)), np.array(sorted(set(trees)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(min_splits), len(counts), len(limits), 4), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                positive = batch.column(0).to_numpy() == 1
                times = batch.column(1).to_numpy()[:, None, None]
                for s, size in enumerate(min_splits):
                    sums = np.cumsum(walk(batch, limits, size), 1)[:, counts - 1]
                    mean = sums / counts[:, None]
                    said = mean >= HALF if ties else mean > HALF
                    for cell, (p, y) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
                        cells[s, ..., cell] += (((said == bool(p)) & (positive == bool(y))[:, None, None]) * times).sum(0)
        s, c, d = np.indices(cells.shape[:3])
        columns = [counts[c.ravel()], np.array(limits)[d.ravel()], np.array(min_splits)[s.ravel()],
                   *np.moveaxis(cells, -1, 0).reshape(4, -1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v.astype(np.int32 if i < 3 else np.int64)) for i, v in enumerate(columns)],
            ["trees", "depth", "min_split", "tn", "fp", "fn", "tp"])

    kind = "trees int, depth int, min_split int, tn bigint, fp bigint, fn bigint, tp bigint"
    times = F.lit(1) if number is None else F.col(number)
    parts = rows.select(
        F.col(label).cast("int").alias("label"), times.cast("bigint").alias("times"), *_inputs(rows)).mapInArrow(run, kind)
    return parts.groupBy("trees", "depth", "min_split").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
