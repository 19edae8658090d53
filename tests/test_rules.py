"""Allow rules, override rules, levels, reports and orderings."""

import itertools

import pytest
from pyspark.sql import functions as F

from shellsieve.operators import features, results
from shellsieve.operators.allowlist import add_allow_rule
from shellsieve.operators.scoring import add_base_score, add_verdict
from shellsieve.plans.hunt import find_malicious, report_commands, score_commands
from shellsieve.vocabulary import FEATURE_COLUMNS, FLAG_COLUMNS, KEYWORDS

RULE_INPUT = (
    "base double, danger_density int, critical_ransomware_alert int, combo_stealth_exploit int, "
    "has_web_request int, critical_evasion_alert int"
)


def judge(spark, rows):
    frame = spark.createDataFrame(rows, RULE_INPUT)
    return add_verdict(add_base_score(frame, base_score=F.col("base"))).collect()


def test_override_rules(spark):
    rows = judge(spark, [
        (80.0, 5, 0, 0, 0, 0), (10.0, 0, 0, 0, 0, 1), (70.0, 0, 1, 1, 1, 0),
        (49.9, 4, 0, 1, 0, 0), (50.0, 0, 0, 0, 0, 0), (79.99, 0, 0, 0, 0, 0),
        (80.0, 0, 0, 0, 0, 0), (99.0, 0, 0, 0, 0, 1),
    ])
    assert [r.score for r in rows] == [100.0, 95.0, 100.0, 49.9, 50.0, 79.99, 80.0, 99.0]
    assert [r.level for r in rows] == [
        "CRITICO", "CRITICO", "CRITICO", "SICURO", "SOSPETTO", "SOSPETTO", "CRITICO", "CRITICO",
    ]
    assert rows[3].reason == "Score assegnato dal Motore ML" and not rows[3].is_malicious
    assert rows[2].reason == (
        "Logica Ransomware Palese, Combo Stealth + Rete (Possibile Loader)"
    )


def test_every_rule_combination_in_order(spark):
    cases = list(itertools.product((0.0, 33.0, 70.0, 100.0), (4, 5), *[(0, 1)] * 4))

    def expected(base, density, ransom, stealth, web, evasion):
        score = base + (35 if density >= 5 else 0)
        score = max(score, 95) if ransom else score
        score += 25 if stealth and web else 0
        score = max(score, 95) if evasion else score
        return min(score, 100)

    got = [r.score for r in judge(spark, cases)]
    assert got == [expected(*case) for case in cases]
    assert all(0 <= score <= 100 for score in got)


def rules(spark, rows):
    frame = spark.createDataFrame(rows, "command string, source string")
    return [r.allow_rule for r in add_allow_rule(frame, "command").collect()]


def test_allow_rules(spark):
    assert rules(spark, [
        ("git status", ""), ("'git.exe' x", ""), ("git  ; iex", ""), ("gitk", ""),
        ("C:\\Users\\u\\Desktop\\a.msi", ""), ("desktop a.exe -enc x", ""), ("desktop", ""),
        ("C:\\Windows\\System32\\x.exe iex bypass", ""), ("c:\\program files (x86)\\a.exe", ""),
        ('"CMD.EXE" ', ""), ("cmd.exe /c", ""), ("notes.txt", "UserAssist 1"),
        ("notes.txt", "userassist"), ("x.ps1", "UserAssist"), ("", ""), ("", "UserAssist"),
    ]) == [1, 1, None, None, 2, None, None, 3, 3, 4, None, 5, None, None, None, 5]


COMMANDS = [
    (1, "git status", "s"), (2, "iex (amsiutils)", "s"), (3, "ls", "s"), (4, None, "s"),
    (5, "[Reflection] kernel32 http", "s"), (6, "notes.txt", "UserAssist"),
]


def entries(spark, rows=COMMANDS):
    return spark.createDataFrame(rows, "cmd_id long, command string, source string")


def test_report_and_scan_agree(spark):
    report = {r.cmd_id: r for r in report_commands(entries(spark), base_score=F.lit(40.0)).collect()}
    scan = {r.cmd_id: r for r in score_commands(entries(spark), base_score=F.lit(40.0)).collect()}
    assert set(report) == {1, 2, 3, 4, 5, 6} and set(scan) == {2, 3, 4, 5}
    for key, row in scan.items():
        assert all(report[key][c] == row[c] for c in (*FEATURE_COLUMNS, "score", "level", "reason"))
    for key in (1, 6):
        row = report[key]
        assert row.is_whitelisted and not row.is_malicious and row.score == 0.0
        assert row.base_ml_score is None and row.level == "SICURO"
        assert all(row[c] is None for c in FEATURE_COLUMNS)
    assert report[5].score == 65.0 and report[4].clean_cmd == ""
    for row in scan.values():
        assert row.danger_density == sum(row[c] for c in FLAG_COLUMNS)
    assert len(FLAG_COLUMNS) == 20 and len(FEATURE_COLUMNS) == 23


def test_missing_model_matters_only_for_scored_rows(spark):
    allowed = entries(spark, COMMANDS[:1])
    assert report_commands(allowed).count() == 1
    assert [r.score for r in report_commands(allowed).collect()] == [0.0]
    assert score_commands(allowed).collect() == []
    with pytest.raises(Exception, match="no model was given"):
        score_commands(entries(spark)).collect()
    with pytest.raises(Exception, match="no model was given"):
        report_commands(entries(spark)).collect()


def test_stricter_keywords_as_an_argument(spark):
    strict = {**KEYWORDS, "has_iex": (*KEYWORDS["has_iex"], "invoke-expression")}
    frame = entries(spark, [(1, "Invoke-Expression x", "s")])
    assert features.add_features(frame).first().has_iex == 0
    assert features.add_features(frame, keywords=strict).first().has_iex == 1


def test_feature_frame_fills_missing_columns(spark):
    frame = spark.createDataFrame([(1, None)], "has_iex int, has_bypass int")
    row = features.feature_frame(frame).first()
    assert tuple(row.__fields__) == FEATURE_COLUMNS
    assert row.has_iex == 1.0 and row.has_bypass == 0.0 and row.danger_density == 0.0


FINDINGS = [
    (1, "02-01-2024 00:00:00", 50.004, "b"), (2, "N/D", 50.001, "A"),
    (3, "01-02-2024 00:00:00 (File)", 99.0, "a"), (4, "weird", 70.0, "B"),
]


def ids(frame):
    return [r.cmd_id for r in frame.collect()]


def test_orders(spark):
    frame = spark.createDataFrame(FINDINGS, "cmd_id long, timestamp string, score double, source string")
    order = results.order_findings
    assert ids(order(frame)) == [3, 4, 1, 2]
    assert ids(order(frame, "score", descending=False)) == [1, 2, 4, 3]
    assert ids(order(frame, "timestamp", descending=False)) == [2, 4, 1, 3]
    assert ids(order(frame, "timestamp", descending=True)) == [2, 4, 3, 1]
    assert ids(order(frame, "source", descending=False)) == [2, 3, 1, 4]
    shown = frame.withColumn("score", F.when(F.col("cmd_id") == 1, "N/D").otherwise(
        F.format_string("%.2f%%", "score")))
    assert ids(order(shown)) == [3, 4, 2, 1]


def test_scan_order_and_columns(spark):
    found = find_malicious(entries(spark), base_score=F.lit(40.0))
    assert ids(found) == [2, 5]
    assert found.columns[:3] == ["cmd_id", "command", "source"]
    table = results.display_columns(found.withColumn("timestamp", F.lit("N/D")))
    assert [r.score for r in table.collect()] == ["95.00%", "65.00%"]
