"""What Spark makes of the plans: nothing twice, Python for one step only, few exchanges."""

import re

import pytest
from pyspark.sql import functions as F

from shellsieve.checks import corpus
from shellsieve.checks.queries import QUERIES
from shellsieve.operators import evaluation
from shellsieve.operators.allowlist import mark_trusted
from shellsieve.operators.features import add_features
from shellsieve.plans import train
from shellsieve.plans.hunt import find_malicious, report_commands, score_commands
from shellsieve.session import settle
from shellsieve.sources.script_blocks import read_event_xml


@pytest.fixture(autouse=True)
def whole_plans(spark):
    """Plan texts are cut at 25 fields otherwise, and with them what is counted."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def commands(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "commands")
    source = corpus.commands(spark, "/root/testdata/sf0.001").withColumn("unused", F.lit("x"))
    source.write.parquet(path)
    return spark.read.parquet(path)



STEPS = {
    "tokens": "(?<![A-Za-z0-9+/])", "payload": "unbase64(", "split literals": "regexp_replace(__full",
    "character codes": "(?iU)\\[char\\]", "entropy": "LOG1P(", "upper case": "IsUppercase",
    "single line": "(?U)[\\s\\x1c-\\x1f]+, ", "Python": "ArrowEvalPython",
}


@pytest.mark.parametrize("make, workers", [
    (lambda c: add_features(c).filter("has_iex = 1 and danger_density > 0 and has_bypass = 0"), 1),
    (lambda c: score_commands(c, base_score=F.length("command")).filter("is_malicious"), 1),
    (lambda c: find_malicious(c, base_score=F.length("command")), 0),
    (lambda c: report_commands(c, base_score=F.length("command")).filter("score > 10 or level = 'x'"), 1),
])
def test_each_text_step_is_planned_once(commands, make, workers):
    plan = physical(make(commands))
    assert {step: plan.count(mark) for step, mark in STEPS.items() if plan.count(mark) > 1} == {}
    assert plan.count("ArrowEvalPython") == workers and "(?iU)" in plan  # the entropy, on Arrow batches


@pytest.mark.parametrize("name", [
    "danger_density", "combo_flags", "keyword_flags", "active_flags", "carrier_features", "heuristics", "verdict",
    "script_check", "findings_sorted", "findings_table", "findings_by_date", "findings_by_source", "findings_top",
    "f2_by_threshold",
])
def test_flags_and_rules_start_no_python_worker(spark, name):
    assert "Python" not in physical(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_scan_reads_only_what_it_needs_and_filters_before_features(commands):
    needed = commands.select("cmd_id", "source", "command")
    plan = physical(score_commands(needed, base_score=F.lit(1.0)))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "unused" not in scan and "user_id" not in scan
    lines = plan.splitlines()
    allow = next(i for i, line in enumerate(lines) if "Filter isnull(allow_rule" in line)
    payload = next(i for i, line in enumerate(lines) if "regexp_extract_all(clean_cmd" in line)
    assert payload < allow
    assert "Exchange" not in plan


def test_hash_join_strategies(spark, commands):
    listed = commands.select(F.sha2("command", 256).alias("sha256"))
    small = physical(mark_trusted(commands, "command", listed))
    large = physical(mark_trusted(commands, "command", listed, broadcast_rows=0))
    assert "BroadcastHashJoin" in small
    assert "SortMergeJoin" in large and "Cartesian" not in large and "NestedLoop" not in large


def test_a_long_hash_list_moves_no_script_text(spark, commands):
    """A thousand listed hashes, of which scripts have a few: those are broadcast."""
    present = commands.filter("cmd_id < 60").select(F.sha2("command", 256).alias("sha256"))
    long = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256")).unionByName(present)
    marked = mark_trusted(commands, "command", long, broadcast_rows=100)
    plan = physical(marked)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning" not in plan
    whole = mark_trusted(commands, "command", long, broadcast_rows=2000)
    key = ["cmd_id", "is_trusted", "trust_reason"]
    assert sorted(marked.select(key).collect()) == sorted(whole.select(key).collect())
    assert marked.filter("is_trusted").count() >= 60


def test_scan_with_a_forest_plans_each_step_once(spark, commands):
    features = train.build_dataset(commands.select("cmd_id", "command", "malicious"))
    model = train.fit_forest(features, train.ForestParams(trees=3, depth=3))
    plan = physical(score_commands(commands, model).filter("is_malicious"))
    assert {step: plan.count(mark) for step, mark in STEPS.items() if plan.count(mark) > 1} == {}
    assert "Exchange" not in plan


def test_folds_exchange_no_text_but_the_id(spark, commands):
    features = train.build_dataset(commands.select("cmd_id", "command", "malicious"))
    table = settle(train.model_input(features))
    plan = evaluation.add_folds(table, "cmd_id")._jdf.queryExecution().optimizedPlan()
    window = re.search(r"Window \[row_number.*", plan.toString())
    assert window and "command" not in {f.name for f in table.schema}
    texts = [f.name for f in table.schema if f.dataType.typeName() == "string"]
    assert texts == []


def test_events_are_split_inside_a_file_by_default(spark, tmp_path):
    (tmp_path / "events.xml").write_text("<Event></Event>\n" * 50_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert read_event_xml(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
