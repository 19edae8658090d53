"""A forest as a table of nodes: equal to Spark's model, pruned as the limits say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellsieve.checks import corpus
from shellsieve.plans import forest_table, train
from shellsieve.session import settle
from shellsieve.sources.tables import load_model, save_model

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    commands = corpus.commands(spark, FOLDER).select("cmd_id", "command", "malicious")
    return settle(train.model_input(train.build_dataset(commands)))


@pytest.fixture(scope="module")
def fitted(rows):
    """The final forest, 55 trees of depth 30, of both kinds."""
    return {c: train.forest_pipeline(train.ForestParams(criterion=c)).fit(train.add_weights(rows, [7.0])) for c in ("gini", "entropy")}


@pytest.fixture(scope="module")
def nodes(fitted):
    return {c: settle(forest_table.node_table(m)) for c, m in fitted.items()}


def shares_of(model, rows):
    judged = model.transform(rows)
    if "leaf_share" not in judged.columns:
        return {r.cmd_id: float(r.probability[1]) for r in judged.select("cmd_id", "probability").collect()}
    return {r.cmd_id: r.leaf_share for r in judged.select("cmd_id", "leaf_share").collect()}


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_walks_equal_the_model_on_all_rows(rows, fitted, nodes, criterion):
    walked = {r.cmd_id: r.leaf_share for r in forest_table.node_scores(rows, nodes[criterion], "cmd_id").collect()}
    expected = shares_of(fitted[criterion], rows)
    assert len(walked) == 10_000 and walked.keys() == expected.keys()
    assert max(abs(walked[i] - expected[i]) for i in expected) < 1e-12


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_importance_equals_the_model(spark, fitted, nodes, criterion):
    found = {r.feature: r.importance for r in forest_table.importance(nodes[criterion]).collect()}
    expected = {r.feature: r.importance for r in train.feature_importance(spark, fitted[criterion]).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k], abs=1e-9) for k in expected)


def test_written_back_it_scores_the_same(rows, fitted, nodes, tmp_path):
    """A pruned table as a model, through a file: the walks over the pruned table."""
    pruned = settle(forest_table.prune(nodes["gini"], min_split=400, depth=6, trees=7))
    model = forest_table.as_model(pruned, fitted["gini"])
    save_model(model, str(tmp_path / "made"))
    loaded = load_model(str(tmp_path / "made"))
    assert loaded.stages[1].getNumTrees == 7
    walked = {r.cmd_id: r.leaf_share for r in forest_table.node_scores(rows, pruned, "cmd_id").collect()}
    assert shares_of(loaded, rows) == pytest.approx(walked, abs=1e-12)


def test_pruning_a_tree_listed_by_hand(spark):
    #            0 (20 rows)
    #      1 (4)          2 (16)
    #    3(2)  4(2)    5 (3)   6 (13)
    #                 7(1) 8(2)
    parents = {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 5, 8: 5}
    sizes = [20, 4, 16, 2, 2, 3, 13, 1, 2]
    listed = []
    for node, size in enumerate(sizes):
        below = [c for c, p in parents.items() if p == node]
        left, right = below or (-1, -1)
        depth = 0 if node == 0 else 1 if node < 3 else 2 if node < 7 else 3
        listed.append((0, node, parents.get(node, -1), depth, left, right, 2 if below else -1, 0.5 if below else None, size,
                       float(size), node / 10, 1.0 if below else -1.0, 0.1, node / 10, [1.0]))
    table = spark.createDataFrame(listed, forest_table.NODES)

    def left_over(**limits):
        got = sorted(forest_table.prune(table, **limits).collect(), key=lambda r: r.node)
        assert [r.node for r in got] == list(range(len(got)))
        for r in got:  # links hold after renumbering, leaves carry no split
            assert (r.left < 0) == (r.feature < 0) == (r.threshold is None)
            assert all(got[c].parent == r.node for c in (r.left, r.right) if c >= 0)
        return [r.rows for r in got], [r.rows for r in got if r.left < 0]

    assert left_over() == (sizes, [2, 2, 13, 1, 2])
    assert left_over(min_split=3) == (sizes, [2, 2, 13, 1, 2])
    assert left_over(min_split=4) == ([20, 4, 16, 2, 2, 3, 13], [2, 2, 3, 13])
    assert left_over(min_split=5) == ([20, 4, 16, 3, 13], [4, 3, 13])
    assert left_over(depth=1) == ([20, 4, 16], [4, 16])
    assert left_over(min_split=21) == ([20], [20])


def test_every_setting_from_one_fit(rows, nodes):
    """Cells by walks with limits equal those of the pruned tables, tree count by tree count."""
    table = nodes["gini"]
    counts, depths, sizes = (1, 20, 55), (2, 5, 30), (2, 300)
    cells = {(r.trees, r.depth, r.min_split): (r.tn, r.fp, r.fn, r.tp)
             for r in forest_table.settings_cells(rows, table, "malicious", counts, depths, sizes).collect()}
    assert len(cells) == 18
    truth = {r.cmd_id: r.malicious for r in rows.select("cmd_id", "malicious").collect()}
    for n, d, s in ((1, 2, 2), (20, 5, 300), (55, 30, 2)):
        cut = forest_table.prune(table, min_split=s, depth=d, trees=n)
        said = {r.cmd_id: r.leaf_share >= 0.5 for r in forest_table.node_scores(rows, cut, "cmd_id").collect()}
        got = [sum(truth[i] == y and said[i] == bool(p) for i in truth) for p, y in ((0, 0), (1, 0), (0, 1), (1, 1))]
        assert cells[n, d, s] == tuple(got)
    assert len({v for v in cells.values()}) > 3


def test_prefix_shares_are_running_means(rows, nodes):
    some = rows.filter("cmd_id < 200")
    found = forest_table.tree_shares(some, nodes["gini"], "cmd_id")
    means = found.select("shares", forest_table.prefix_shares(F.col("shares"), (1, 7, 55)).alias("means")).collect()
    assert len(means) == 200
    for r in means:
        assert r.means == pytest.approx([np.mean(r.shares[:n]) for n in (1, 7, 55)])


def test_united_forests_number_their_trees_on(rows, fitted):
    both = forest_table.node_table(fitted["gini"], fitted["gini"])
    one = forest_table.node_table(fitted["gini"])
    shares = [{r.cmd_id: r.leaf_share for r in forest_table.node_scores(rows, t, "cmd_id").collect()} for t in (one, both)]
    assert both.select("tree").distinct().count() == 110
    assert shares[0] == pytest.approx(shares[1], abs=1e-12)
    for table in (one, both):
        forest_table.drop_nodes(table)
