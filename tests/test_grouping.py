"""Forests grown from groups of rows, against the rows themselves."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from shellsieve.plans import forest_table, grouping, train
from shellsieve.vocabulary import FEATURE_COLUMNS


@pytest.fixture(scope="module")
def rows(spark):
    """4,000 rows, every entropy its own, few values otherwise; the label has some noise."""
    i = F.col("id")
    values = {c: F.lit(0.0) for c in FEATURE_COLUMNS} | {
        "entropy_log_length": (i * 7919 % 4000) / 4000.0, "has_iex": (i % 2).cast("double"),
        "has_bypass": (i % 5 == 0).cast("double"), "danger_density": (i % 7).cast("double"),
    }
    hostile = ((i * 7919 % 4000 > 2500) & (i % 2 == 0)) | (i % 7 == 6)
    table = spark.range(0, 4000, 1, 4).select(
        i.alias("cmd_id"), (hostile != (i % 50 == 0)).cast("int").alias("malicious"), *[v.alias(c) for c, v in values.items()])
    return table.persist()


@pytest.fixture()
def grouped(monkeypatch):
    monkeypatch.setattr(grouping, "GROUP_ROWS", 100)
    monkeypatch.setattr(grouping, "GROUP_SIZE", 2)


@pytest.fixture()
def fits(monkeypatch):
    """How many rows each fit was given."""
    seen = []
    for grower in (RandomForestRegressor, RandomForestClassifier):
        def counted(self, dataset, params=None, real=grower._fit):
            seen.append(dataset.count())
            return real(self, dataset)

        monkeypatch.setattr(grower, "_fit", counted)
    return seen


def written(rows):
    return train.add_weights(train.settle(train.add_vector(rows)), [7.0])


@pytest.mark.parametrize("min_leaf", [1, 40])
def test_a_tree_of_groups_is_the_tree_of_the_rows(rows, grouped, min_leaf):
    params = train.ForestParams(
        trees=1, depth=6, bootstrap=False, features_per_split="all", bins=16, min_split=2, min_leaf=min_leaf)
    table = written(rows)
    groups = grouping.group_rows(table, "malicious", ["weight_7"], 16)
    assert set(groups.borders) == {"entropy_log_length"} and groups.table.count() < 1200
    model = train.fit_groups(groups, params)
    rounded = written(grouping.rounded_up(rows, groups.borders))
    plain = train.fit_pipeline(rounded, params)
    got, want = (forest_table.node_table(m) for m in (model, plain))
    shown = [n.orderBy("node").select(
        "node", "left", "right", "feature", "rows", "weight", F.round("share", 9), F.round("gain", 9)).collect() for n in (got, want)]
    assert shown[0] == shown[1] and len(shown[0]) > 5
    assert min(r.rows for r in shown[0]) >= min_leaf
    # Rows as they are, between borders, go where their groups went.
    own = {r.cmd_id: r.leaf_share for r in train.predictions(model, table).collect()}
    for r in train.predictions(plain, rounded).collect():
        assert own[r.cmd_id] == pytest.approx(r.leaf_share)


def test_draws_are_poisson_and_the_same_again(rows, grouped):
    groups = grouping.group_rows(written(rows), "malicious", ["weight_7"], 16)
    drawn = [grouping.with_draws(groups, "malicious", 55, 42).table for _ in range(2)]
    sums = [sorted(map(tuple, t.select("__rows", "__draws").collect())) for t in drawn]
    assert sums[0] == sums[1]
    total = [sum(r[1][t] for r in sums[0]) for t in range(55)]
    assert len(set(total)) > 40 and abs(sum(total) / 55 - 4000) < 50
    spread = sum((draw - n) ** 2 for n, draws in sums[0] for draw in draws) / 55
    assert spread == pytest.approx(4000, rel=0.1)


def test_many_rows_are_grown_from_groups(rows, grouped, fits):
    params = train.ForestParams(trees=4, depth=8, bins=16, features_per_split="all")
    metrics = train.cross_validate(rows, "cmd_id", 2, params).collect()
    assert len(fits) == 8 and max(fits) < 1200
    grouping.GROUP_ROWS = 1 << 30
    plain = train.cross_validate(rows, "cmd_id", 2, params).collect()
    assert len(fits) == 10 and sum(fits[8:]) == 4000
    for got, want in zip(sorted(metrics), sorted(plain)):
        assert got.tn + got.fp == want.tn + want.fp and got.fn + got.tp == want.fn + want.tp
        assert got.f1 == pytest.approx(want.f1, abs=0.05)


def test_a_search_without_bootstraps_fits_and_judges_equal_rows_as_one(rows, grouped, fits):
    whole = rows.withColumn("entropy_log_length", F.lit(0.0))
    grid = {"trees": (1,), "depth": (1, 3), "bootstrap": (False,), "features_per_split": ("all",),
            "class_weight": (train.BALANCED,), "min_leaf": (30,), "criterion": ("gini", "entropy")}

    def told():
        report = train.grid_search(whole, "cmd_id", grid, k=2).report.collect()
        return {r.combination: r.f2 for r in report}

    got, number = told(), len(fits)
    assert max(fits) < 3500
    grouping.GROUP_ROWS = 1 << 30
    assert told() == pytest.approx(got) and min(fits[number:]) >= 1999


def test_a_search_with_bootstraps_fits_and_judges_groups(rows, grouped, fits):
    """Trees of drawn groups, as many as the largest forest of the grid has; scores as of rows."""
    grid = {"trees": (2, 5), "depth": (3, 8), "bins": (8,), "features_per_split": ("all",), "criterion": ("gini", "entropy"),
            "class_weight": (7.0, train.BALANCED)}

    def told():
        found = train.grid_search(rows, "cmd_id", grid, k=2)
        best = train.predictions(found.best_model, written(rows)).filter("prediction <> malicious").count()
        return found, {r.combination: r.f2 for r in found.report.collect()}, best

    found, got, wrong = told()
    last = int(found.best().first().params["numTrees"])
    assert len(fits) == 2 * 2 * 2 * 5 + last and max(fits) < 1200
    assert found.best_model.stages[1].getNumTrees == last
    number = len(fits)
    grouping.GROUP_ROWS = 1 << 30
    _, want, wrong_of_rows = told()
    assert len(fits) == number + 2 * 2 * 2 * 2 + 1 and min(fits[number:]) >= 1999
    assert got == pytest.approx(want, abs=0.04) and wrong == pytest.approx(wrong_of_rows, abs=150)


def test_the_first_trees_of_a_searched_forest_are_the_smaller_forest(rows, grouped, fits):
    def told(trees):
        grid = {"trees": trees, "depth": (6,), "bins": (8,), "features_per_split": ("auto",)}
        report = train.grid_search(rows, "cmd_id", grid, k=2).report.collect()
        return {int(r.params["numTrees"]): r.f2 for r in report}

    both = told((3, 7))
    assert both[3] == told((3,))[3] and both[7] == told((7,))[7] and max(fits) < 1200


def test_rows_that_differ_or_are_few_or_not_finite_stay_rows(spark, rows, monkeypatch):
    table = written(rows)
    assert grouping.group_rows(table, "malicious", ["weight_7"], 128) is None
    monkeypatch.setattr(grouping, "GROUP_ROWS", 100)
    assert grouping.group_rows(table, "malicious", ["weight_7"], 1024) is None
    assert grouping.group_rows(table, "malicious", ["weight_7"], 16, exact=True) is None
    odd = table.withColumn("entropy_log_length", F.when(F.col("cmd_id") == 3, float("nan")).otherwise(F.col("entropy_log_length")))
    monkeypatch.setattr(grouping, "GROUP_SIZE", 2)
    assert grouping.group_rows(odd, "malicious", ["weight_7"], 16) is None
