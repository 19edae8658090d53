"""Folds, metrics and forests: properties, since no forest gives equal values elsewhere."""

import os

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from shellsieve.checks import corpus
from shellsieve.operators import evaluation
from shellsieve.operators.scoring import VECTOR
from shellsieve.plans import forest_table, train
from shellsieve.plans.hunt import find_malicious, score_commands
from shellsieve.session import release, work_folder
from shellsieve.sources.tables import (
    load_model,
    read_features,
    read_labelled,
    save_model,
    write_features,
)
from shellsieve.vocabulary import FEATURE_COLUMNS

SMALL = train.ForestParams(trees=10, depth=6)


@pytest.fixture(scope="module")
def features(spark):
    commands = corpus.commands(spark, "/root/testdata/sf0.001")
    table = train.build_dataset(commands.select("cmd_id", "command", "malicious"))
    return table.persist()


@pytest.fixture(scope="module")
def model(features):
    return train.fit_forest(features, SMALL)


def test_folds_hold_equal_shares(spark):
    frame = spark.range(1003).withColumn("malicious", (F.col("id") < 17).cast("int"))
    folded = evaluation.add_folds(frame, "id")
    counts = folded.groupBy("malicious", "fold").count().collect()
    assert folded.count() == 1003 and len(counts) == 10
    for label, rows in ((0, 986), (1, 17)):
        sizes = [r["count"] for r in counts if r.malicious == label]
        assert sum(sizes) == rows and max(sizes) - min(sizes) <= 1
    again = evaluation.add_folds(frame.repartition(7), "id")
    assert sorted(folded.collect()) == sorted(again.collect())
    other = evaluation.add_folds(frame, "id", seed=43)
    assert sorted(folded.collect()) != sorted(other.collect())


def test_folds_do_not_window_over_a_whole_class(spark):
    frame = spark.range(5000).withColumn("malicious", F.lit(0))
    plan = evaluation.add_folds(frame, "id")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("__bucket" in line for line in windows)


def test_metrics_without_positives(spark):
    cells = spark.createDataFrame([(0, 5, 0, 0, 0), (1, 0, 0, 4, 0), (2, 0, 3, 0, 0)],
                                  "fold int, tn long, fp long, fn long, tp long")
    rows = {r.fold: r for r in evaluation.add_metrics(cells).collect()}
    assert rows[0].acc == 1.0
    assert all(rows[i][m] == 0.0 for i in rows for m in ("prec", "rec", "f1"))
    assert evaluation.summarise(evaluation.add_metrics(cells)).first().mean_acc == pytest.approx(
        100 / 3
    )


def test_forest_is_deterministic(spark, features, model):
    commands = corpus.commands(spark, "/root/testdata/sf0.001")
    again = train.fit_forest(features, SMALL)
    scores = [
        sorted((r.cmd_id, r.base_ml_score) for r in score_commands(commands, m).collect())
        for m in (model, again)
    ]
    assert scores[0] == scores[1]


def test_the_final_forest_is_better_than_guessing_on_rows_it_has_not_seen(spark, features):
    """Every row judged by the forest of the final settings that did not see its fold."""
    table, written = train.training_table(features, "cmd_id", 2)
    judged = train.held_out_predictions(table, 2, train.ForestParams()).select("malicious", "leaf_share").collect()
    for part in written:
        release(part)
    hostile = [r.leaf_share >= 0.5 for r in judged if r.malicious == 1]
    benign = [r.leaf_share >= 0.5 for r in judged if r.malicious == 0]
    assert len(judged) == 1000 and all(0.0 <= r.leaf_share <= 1.0 for r in judged)
    assert sum(hostile) / len(hostile) > 0.9 and sum(benign) / len(benign) < 0.1


def test_importances(spark, model):
    ranked = train.feature_importance(spark, model).collect()
    values = [r.importance for r in ranked]
    assert {r.feature for r in ranked} == set(FEATURE_COLUMNS)
    assert sum(values) == pytest.approx(100.0) and values == sorted(values, reverse=True)
    assert [r.importance for r in train.top_features(spark, model).collect()] == values[:10]


def test_model_round_trip(spark, model, tmp_path):
    save_model(model, str(tmp_path / "model"))
    loaded = load_model(str(tmp_path / "model"))
    commands = corpus.commands(spark, "/root/testdata/sf0.001")
    first, second = (
        sorted((r.cmd_id, r.score) for r in score_commands(commands, m).collect())
        for m in (model, loaded)
    )
    assert first == second


def test_cross_validation(features):
    metrics = train.cross_validate(features, "cmd_id", 3, SMALL, parallelism=3)
    rows = metrics.collect()
    assert {r.fold for r in rows} == {0, 1, 2}
    assert sum(r.tn + r.fp + r.fn + r.tp for r in rows) == features.count()
    assert all(r.rec > 0.8 for r in rows)
    total = train.cross_validation_summary(metrics).first()
    assert total.tp == sum(r.tp for r in rows)
    assert total.mean_f1 == pytest.approx(100 * sum(r.f1 for r in rows) / 3)


def test_folds_before_or_after_the_features_are_the_same(spark, features):
    labelled = corpus.commands(spark, "/root/testdata/sf0.001").select(
        "cmd_id", "command", "malicious"
    )
    dealt = train.labelled_folds(labelled, "cmd_id", 3)
    assert dealt.columns == ["cmd_id", "malicious", "fold"]
    early = features.join(dealt.select("cmd_id", "fold"), "cmd_id")
    tables = [train.training_table(f, "cmd_id", 3)[0] for f in (early, features)]
    folds = [sorted((r.cmd_id, r.fold) for r in t.collect()) for t in tables]
    assert folds[0] == folds[1] and len(folds[0]) == 1000


def test_null_ids_get_folds(spark):
    frame = spark.createDataFrame([(1, 0), (None, 0), (None, 1), (2, None)], "id long, malicious int")
    assert evaluation.add_folds(frame, "id").filter("fold IS NOT NULL").count() == 4


def test_a_forest_of_one_split_has_the_shares_of_its_leaves(spark):
    """Both leaves predict class 1; a classifier would merge them and mix their shares."""
    rows = [(1, 1)] * 9 + [(1, 0)] * 1 + [(0, 1)] * 6 + [(0, 0)] * 4
    base = {c: 0 for c in FEATURE_COLUMNS}
    frame = spark.createDataFrame(
        [{**base, "danger_density": d, "malicious": m} for d, m in rows],
        ", ".join(f"{c} int" for c in (*FEATURE_COLUMNS, "malicious")),
    )
    params = train.ForestParams(
        trees=1, depth=1, bootstrap=False, features_per_split="all", class_weight=7.0)
    model = train.fit_forest(frame, params)
    shares = {r.danger_density: r.leaf_share for r in model.transform(frame.fillna(0)).collect()}
    assert shares == {1: pytest.approx(63 / 64), 0: pytest.approx(42 / 46)}


def test_life_cycle_over_files(spark, tmp_path):
    """The README's example: labelled files, features, validation, search, model, scan."""
    commands = corpus.commands(spark, "/root/testdata/sf0.001")
    labelled = commands.select(F.col("cmd_id").alias("id"), "command", "malicious")
    labelled.write.parquet(str(tmp_path / "labelled"))
    read = read_labelled(spark, str(tmp_path / "labelled"))
    write_features(train.build_dataset(read), str(tmp_path / "features"))
    features = read_features(spark, str(tmp_path / "features"))
    metrics = train.cross_validate(features, "id", 3, SMALL)
    assert metrics.count() == 3
    result = train.grid_search(features, "id", {"trees": (2, 5), "criterion": ("gini", "entropy")}, k=2)
    assert result.report.count() == 4
    save_model(result.best_model, str(tmp_path / "model"))
    found = find_malicious(commands, load_model(str(tmp_path / "model")))
    assert found.count() > 100
    labelled.drop("id").write.parquet(str(tmp_path / "nameless"))
    with pytest.raises(ValueError, match="no column 'id'"):
        read_labelled(spark, str(tmp_path / "nameless"))
    with pytest.raises(ValueError, match="lacks"):
        read_features(spark, str(tmp_path / "nameless"))
    with pytest.raises(ValueError, match="no column 'key'"):
        train.cross_validate(features, "key", 2, SMALL)


def test_written_tables_are_deleted(spark, features):
    folder = os.path.join(work_folder(spark), "settled")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    train.fit_forest(features, SMALL)
    train.cross_validate(features, "cmd_id", 2, SMALL)
    assert set(os.listdir(folder)) == before


def test_full_grid():
    grid = train.expand_grid(train.FULL_GRID)
    assert len(grid) == len(set(grid)) == 14 * 4 * 2 * 3 * 2
    assert train.ForestParams() in grid
    with pytest.raises(ValueError):
        train.expand_grid({"no_such_setting": (2, 3)})


def test_grid_search(features):
    grid = {"trees": (1, 8), "class_weight": (7.0, train.BALANCED), "depth": (1, 6)}
    result = train.grid_search(features, "cmd_id", grid, k=2, parallelism=4)
    rows = result.report.collect()
    assert len(rows) == 8 and {r.combination for r in rows} == set(range(8))
    assert [r.f2 for r in rows] == sorted((r.f2 for r in rows), reverse=True)
    best = result.best().first()
    assert best.f2 == rows[0].f2
    assert result.best_model.stages[1].getNumTrees == int(best.params["numTrees"])
    assert {r.params["weightCol"] for r in rows} == {"weight_7", "weight_balanced"}


def test_f2_matches_the_evaluator(spark):
    rows = [(1, 1.0)] * 7 + [(1, 0.0)] * 3 + [(0, 1.0)] * 2 + [(0, 0.0)] * 8
    frame = spark.createDataFrame(rows, "malicious int, prediction double")
    cells = evaluation.confusion(frame, by=()).select(evaluation.f_beta(2.0)).first()[0]
    assert train.f2_evaluator().evaluate(frame) == pytest.approx(cells)


def test_balanced_weights(spark):
    frame = spark.createDataFrame([(1,)] * 2 + [(0,)] * 6, "malicious int")
    rows = train.add_weights(frame, [train.BALANCED, 5.0]).distinct().collect()
    assert {(r.malicious, r.weight_balanced, r.weight_5) for r in rows} == {
        (1, 2.0, 5.0), (0, 8 / 12, 1.0),
    }


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_a_cut_forest_is_the_forest_grown_to_that_depth(spark, features, criterion):
    """F2 of every depth from one fit, against Spark's own forests and evaluator."""
    table, written = train.training_table(features, "cmd_id", 2)
    kept, held_out = table.filter("fold <> 0"), table.filter("fold = 0")

    def grown(depth):
        return train.fit_table(kept, train.ForestParams(trees=3, depth=depth, criterion=criterion, min_split=2))

    nodes = forest_table.node_table(grown(8))
    told = train.f2_by_depth(held_out, nodes, 3, [1, 2, 4, 8], criterion)
    for depth, f2 in told.items():
        judged = train.predictions(grown(depth), held_out)
        assert f2 == pytest.approx(train.f2_evaluator().evaluate(judged), abs=1e-12)
    assert len(set(told.values())) > 1
    forest_table.drop_nodes(nodes)
    for part in written:
        release(part)


def test_the_grid_grows_one_forest_for_all_depths(features, monkeypatch):
    grown, real = [], RandomForestRegressor.fit

    def counted(self, dataset, params=None):
        grown.append(self.copy(params).getMaxDepth() if params else self.getMaxDepth())
        return real(self, dataset, params)

    monkeypatch.setattr(RandomForestRegressor, "fit", counted)
    result = train.grid_search(features, "cmd_id", {"trees": (2,), "depth": (1, 3, 6)}, k=2)
    # a fit with a map of parameters calls itself on a copy
    assert {r.params["maxDepth"] for r in result.report.collect()} == {"1", "3", "6"}
    assert len(grown) <= 2 * 2 + 1 and set(grown[:2]) == {6}


def test_stored_tables_have_the_vector_that_fits_read(features):
    table, written = train.training_table(features, "cmd_id", 2)
    model = train.fit_pipeline(table, SMALL)
    plan = table.select(VECTOR)._jdf.queryExecution().executedPlan().toString()
    assert VECTOR in plan and "UDF" not in plan
    assert isinstance(model.stages[0], VectorAssembler)
    own = train.predictions(model, table).select("cmd_id", "leaf_share").collect()
    assembled = model.transform(table.drop(VECTOR)).select("cmd_id", "leaf_share").collect()
    assert sorted(own) == sorted(assembled)
    for part in written:
        release(part)


@pytest.mark.parametrize("rows, parts", [(30_000, 3), (5_000, 1)])
def test_texts_of_one_row_group_are_read_by_several_tasks(spark, tmp_path, rows, parts):
    spark.range(0, rows, 1, 1).select(
        F.col("id").alias("cmd_id"), F.concat(F.lit("ls "), "id").alias("command"), (F.col("id") % 2).alias("malicious"),
    ).write.parquet(str(tmp_path / "one"))
    features = train.build_dataset(spark.read.parquet(str(tmp_path / "one")))
    sizes = features.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("cmd_id").alias("ids")).collect()
    assert len(sizes) == parts and sum(r.n for r in sizes) == sum(r.ids for r in sizes) == rows
    assert max(r.n for r in sizes) - min(r.n for r in sizes) <= 1


def test_stored_vectors_hold_what_is_shorter_and_give_the_same_forest(spark, features):
    table, written = train.training_table(features, "cmd_id", 2)
    kinds = {type(r[0]) for r in table.select(VECTOR).collect()}
    assert SparseVector in kinds
    dense = table.withColumn(VECTOR, array_to_vector(F.array(*FEATURE_COLUMNS)))
    shown = [train.forest(SMALL).fit(t).toDebugString.split("\n", 1)[1] for t in (table, dense)]
    assert shown[0] == shown[1]
    for part in written:
        release(part)
    full = spark.createDataFrame([(float("nan"), *[1.0] * 22)], ", ".join(f"{c} double" for c in FEATURE_COLUMNS))
    assert isinstance(train.add_vector(full).first()[VECTOR], DenseVector)
