"""Bootstraps by hash, weights per bootstrap, and a search that goes on where it was killed."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shellsieve.checks import corpus
from shellsieve.plans import bagging, forest_table, search, train
from shellsieve.session import release, settle

FOLDER = "/root/testdata/sf0.001"
GRID = {"trees": (1, 3), "depth": (3, 8), "min_split": (2, 200), "class_weight": (7.0,), "criterion": ("gini", "entropy"), "min_leaf": (1,)}


@pytest.fixture(scope="module")
def features(spark):
    return settle(train.build_dataset(corpus.commands(spark, FOLDER).select("cmd_id", "command", "malicious")))


def test_draws_are_poisson_and_the_same_again(spark):
    rows = spark.range(20_000).withColumn("n", bagging.draws("id", F.lit(3), 42))
    seen = Counter(r.n for r in rows.collect())
    for k in range(4):
        assert seen[k] / 20_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.012)
    again = spark.range(20_000).repartition(5, F.rand()).withColumn("n", bagging.draws("id", F.lit(3), 42))
    assert sorted(again.collect()) == sorted(rows.collect())
    for other in (bagging.draws("id", F.lit(4), 42), bagging.draws("id", F.lit(3), 43)):
        assert rows.filter(F.col("n") != other).count() > 5_000


def test_sizes_and_weights_are_those_of_each_bootstrap(spark, features):
    table = train.model_input(features)
    sizes = {r.tree: r for r in bagging.class_sizes(table, "cmd_id", "malicious", 3, 42).collect()}
    for tree in range(3):
        drawn = Counter(r.malicious for r in bagging.bootstrap(table, "cmd_id", tree, 42).select("malicious").collect())
        assert (sizes[tree].n0, sizes[tree].n1) == (drawn[0], drawn[1])
        # both classes weigh the same, and a row weighs one on average
        assert drawn[0] * sizes[tree].w0 == pytest.approx(drawn[1] * sizes[tree].w1)
        assert drawn[0] * sizes[tree].w0 + drawn[1] * sizes[tree].w1 == pytest.approx(sum(drawn.values()))
    one_class = bagging.class_sizes(table.filter("malicious = 0"), "cmd_id", "malicious", 1, 42).first()
    assert one_class.n1 == 0 and one_class.w1 is None


def test_draws_are_hashed_once(spark, features):
    """One mention of the hash in a bootstrap's filter, none when the draws are stored."""
    table = train.model_input(features)
    plan = bagging.bootstrap(table, "cmd_id", 1, 42)._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line and "sha2" in line)
    assert condition.count("sha2(") == 1
    stored = settle(bagging.all_draws(table, "cmd_id", 3, 42))
    rows = bagging.bootstrap(stored, "cmd_id", 1, 42)
    assert "sha2" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.columns == table.columns
    assert sorted(rows.collect()) == sorted(bagging.bootstrap(table, "cmd_id", 1, 42).collect())
    sizes = [sorted(bagging.class_sizes(t, "cmd_id", "malicious", 3, 42).collect()) for t in (table, stored)]
    assert sizes[0] == sizes[1]
    release(stored)


def test_forest_of_weighted_bootstraps(features):
    params = train.ForestParams(trees=4, depth=8, class_weight=train.SUBSAMPLE, min_split=2)
    model = train.fit_forest(features, params, "cmd_id")
    assert model.stages[1].getNumTrees == 4
    nodes = forest_table.node_table(model)
    roots = {r.tree: r for r in nodes.filter("node = 0").collect()}
    sizes = bagging.class_sizes(train.model_input(features), "cmd_id", "malicious", 4, 42).collect()
    for r in sizes:  # the root holds the whole bootstrap, and both classes weigh alike there
        assert roots[r.tree].rows == r.n0 + r.n1 and roots[r.tree].share == pytest.approx(0.5)
    forest_table.drop_nodes(nodes)
    with pytest.raises(ValueError, match="id"):
        train.fit_forest(features, params)


def test_smallest_node_for_a_split_in_the_fitted_model(features):
    model = train.fit_forest(features, train.ForestParams(trees=3, depth=30, min_split=100))
    nodes = forest_table.node_table(model)
    assert nodes.filter("left >= 0 AND rows < 100").isEmpty() and not nodes.filter("left >= 0").isEmpty()
    forest_table.drop_nodes(nodes)


def test_a_killed_search_goes_on(spark, features, tmp_path, monkeypatch):
    ledger, real, calls = str(tmp_path / "ledger"), train.fit_table, []

    def dies_after_two(*args):
        calls.append(args[1])
        if len(calls) >= 3:
            raise RuntimeError("the driver died")
        return real(*args)

    monkeypatch.setattr(train, "fit_table", dies_after_two)
    with pytest.raises(RuntimeError, match="died"):
        search.search(features, "cmd_id", ledger, GRID, k=2, parallelism=1)
    assert search.ledger_rows(spark, ledger).count() == 2 * 8
    monkeypatch.setattr(train, "fit_table", real)
    found = search.search(features, "cmd_id", ledger, GRID, k=2, parallelism=1)
    assert found.grown == 2
    rows = found.report.collect()
    assert len(rows) == 2 * 8 and {r.folds for r in rows} == {2}
    assert [r.f2 for r in rows] == sorted((r.f2 for r in rows), reverse=True)
    best = rows[0]
    assert (best.criterion, best.trees, best.depth, best.min_split) == (
        found.best.criterion, found.best.trees, found.best.depth, found.best.min_split)
    assert found.best_model.stages[1].getNumTrees == best.trees
    again = search.search(features, "cmd_id", ledger, GRID, k=2)
    assert again.grown == 0 and again.report.collect() == rows
    other = features.filter("cmd_id > 10")
    data = {search.fingerprint(t) for t in (train.model_input(features), train.model_input(other))}
    assert len(data) == 2


def test_full_search_has_every_setting():
    grid = search.settings(train.FULL_SEARCH)
    # 14 tree counts, 4 weights, 2 criteria, 3 depths, 2 leaf sizes, 3 node sizes
    assert math.prod(map(len, grid.values())) == 14 * 4 * 2 * 3 * 2 * 3
    with pytest.raises(ValueError):
        search.settings({"no_such_setting": (1,)})
