"""The scan as a stream gives what the batch scan gives."""

import pytest
from pyspark.sql import functions as F

from shellsieve.checks import corpus
from shellsieve.operators.results import display_columns, order_findings, shown_percent
from shellsieve.plans import train
from shellsieve.plans.hunt import find_malicious, score_commands
from shellsieve.sources.history import read_history
from shellsieve.schema import REGISTRY_VALUE
from shellsieve.streaming.scan import (
    append_findings,
    keep_ranking,
    read_ranking,
    stream_findings,
    watch_all,
    watch_events,
    watch_history,
    watch_registry,
    watch_scripts,
)
from test_sources import block, event

LINES = ["ls", "iex (amsiutils)", "git status", "Set-MpPreference x", "notes"]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"h{i}.txt").write_text("\n".join(f"{line} {i}" for line in LINES))
    base = F.length("command") % 50
    stream = stream_findings(watch_history(spark, str(folder), files_per_batch=1), base_score=base)

    def run():
        append_findings(
            stream, str(tmp_path / "out"), str(tmp_path / "check"), until_caught_up=True
        ).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out"))
        return sorted((r.command, r.score, r.level) for r in found.collect())

    def batch():
        scored = score_commands(read_history(spark, str(folder)), base_score=base)
        return sorted((r.command, r.score, r.level) for r in scored.filter("is_malicious").collect())

    assert run() == batch() and len(batch()) == 6
    # What is stored can be ranked and shown, and says where it comes from.
    stored = spark.read.parquet(str(tmp_path / "out"))
    ranked = order_findings(stored)
    assert [r.score for r in ranked.collect()] == sorted((r.score for r in stored.collect()), reverse=True)
    assert {r.origin.rsplit("/", 1)[-1] for r in display_columns(ranked).collect()} == {"h0.txt", "h1.txt", "h2.txt"}
    assert find_malicious(read_history(spark, str(folder)), base_score=base).count() == ranked.count()
    assert find_malicious(read_history(spark, str(folder)).drop("cmd_id"), base_score=base).count() == ranked.count()
    (folder / "late.txt").write_text("iex (amsiutils) late\n")
    assert run() == batch() and len(batch()) == 7


def test_stream_with_a_forest(spark, tmp_path):
    commands = corpus.commands(spark, "/root/testdata/sf0.001")
    model = train.fit_forest(
        train.build_dataset(commands.select("cmd_id", "command", "malicious")),
        train.ForestParams(trees=5, depth=5),
    )
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "h.txt").write_text("\n".join(f"{line} {i}" for line in LINES for i in range(9)))
    append_findings(
        stream_findings(watch_history(spark, str(folder)), model),
        str(tmp_path / "out"), str(tmp_path / "check"), until_caught_up=True,
    ).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = score_commands(read_history(spark, str(folder)), model).filter("is_malicious")
    key = lambda frame: sorted((r.command, r.score) for r in frame.collect())
    assert key(streamed) == key(batch) and batch.count() >= 9


def test_all_sources_as_streams_with_a_kept_ranking(spark, tmp_path):
    """Batch by batch the ranking is that of all that is stored; a batch run again is stored once."""
    folders = {name: tmp_path / name for name in ("h", "e", "r", "s")}
    for folder in folders.values():
        folder.mkdir()
    for i in range(3):
        (folders["h"] / f"h{i}.txt").write_text("\n".join(f"{line} {i}" for line in LINES))
        (folders["e"] / f"e{i}.xml").write_text("<Events>" + event(block(f"iex{chr(10)} {i}")) * 2 + "</Events>")
    for i in range(2):
        (folders["s"] / f"s{i}.ps1").write_bytes(f"iex (script {i})\r\nmore".encode())
    values = [("hive", r"Software\Foo", None, f"v{i}", f"powershell {'x' * i}") for i in range(5)]
    spark.createDataFrame(values, REGISTRY_VALUE).write.mode("append").parquet(str(folders["r"]))
    base = F.col("source_no") + 60.0
    entries = watch_all(
        watch_history(spark, str(folders["h"]), 1), watch_events(spark, str(folders["e"]), 1), None,
        watch_registry(spark, str(folders["r"]), 1), watch_scripts(spark, str(folders["s"]), 1))
    out = str(tmp_path / "out")

    def run(check):
        keep_ranking(stream_findings(entries, base_score=base), out, str(tmp_path / check), n=9, until_caught_up=True).awaitTermination()
        stored = spark.read.parquet(f"{out}/findings").drop("batch")
        shown = ["source_no", "command", "score", "origin"]
        ranked = [tuple(r) for r in read_ranking(spark, out).select(shown).collect()]
        assert ranked == [tuple(r) for r in order_findings(stored).limit(9).select(shown).collect()]
        return stored.count(), ranked

    first = run("check")
    # 12 lines that no allow rule lets pass, 6 of them evasions; 6 events, 5 values, 2 scripts
    assert first[0] == 25 and [r[0] for r in first[1]] == [0] * 6 + [4, 4, 3]
    # Without its checkpoint the stream runs all batches again, into the same folders.
    assert run("again") == first
    with pytest.raises(ValueError):
        watch_all(None)


def test_halves_are_shown_even(spark):
    frame = spark.createDataFrame([(53.125,), (53.135,), (0.375,), (100.0,)], "score double")
    shown = [r[0] for r in frame.select(shown_percent(F.col("score"))).collect()]
    assert shown == ["53.12%", "53.14%", "0.38%", "100.00%"]
    ties = spark.createDataFrame([(1, 53.124), (2, 53.125), (3, 53.126)], "cmd_id long, score double")
    assert [r.cmd_id for r in order_findings(ties).collect()] == [3, 1, 2]
