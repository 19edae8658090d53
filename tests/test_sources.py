"""Readers on small files, and entries from tables."""

import hashlib
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from shellsieve.functions import times
from shellsieve.operators.allowlist import mark_trusted
from shellsieve.plans.hunt import check_scripts, find_malicious
from shellsieve.schema import LABELLED_COMMAND, REGISTRY_VALUE
from shellsieve.sources.history import read_history
from shellsieve.sources.registry import (
    persistence_entries,
    registry_entries,
    storage_entries,
)
from shellsieve.sources.script_blocks import read_script_blocks
from shellsieve.sources.scripts import read_scripts
from shellsieve.sources.tables import (
    combine_sources,
    read_features,
    read_labelled,
    write_features,
)

MOMENT = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)


def put(path, data, moment=MOMENT):
    path.write_bytes(data)
    os.utime(path, (moment.timestamp(), moment.timestamp()))
    return str(path)


def test_history(spark, tmp_path):
    path = put(
        tmp_path / "history.txt",
        b"Get-Date\n\n  dir  \r\nfoo\xffbar\r\n\xc2\xa0\xc2\xa0\n`\nold\rmac\ngenuine \xef\xbf\xbd",
    )
    rows = read_history(spark, path).orderBy("cmd_id").collect()
    assert [r.command for r in rows] == [
        "Get-Date", "dir", "foobar", "`", "old", "mac", "genuine �",
    ]
    assert {r.source for r in rows} == {"Console_History"}
    assert {r.timestamp for r in rows} == {"02-01-2024 03:04:05 (File)"}


EVENT = (
    '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System>'
    "<EventID{attr}>{id}</EventID>{time}<Computer>host7</Computer></System>{data}</Event>"
)


def event(data="", number="4104", attr="", time='<TimeCreated SystemTime="2024-01-02T03:04:05.123Z"/>'):
    return EVENT.format(id=number, attr=attr, time=time, data=data)


def block(*texts, name="ScriptBlockText"):
    inner = "".join(f'<Data Name="{name}">{t}</Data>' for t in texts)
    return f'<EventData><Data Name="MessageNumber">1</Data>{inner}</EventData>'


EVENTS = [
    event(block("iex&#10;foo ")),
    event(block("with attribute"), attr=' Qualifiers="0"'),
    event(block("odd time"), time='<TimeCreated SystemTime="weird.1"/>'),
    event(block("no time"), time="<TimeCreated/>"),
    event(block("first", "second")),
    event(block("other id"), number="4103"),
    event(),
    event(block("null")),
    event(block("other field", name="Path")),
    event(block("single digits"), time='<TimeCreated SystemTime="2024-1-2T3:4:5Z"/>'),
    event(block("no such day"), time='<TimeCreated SystemTime="2024-02-30T03:04:05.5Z"/>'),
]
EXPECTED_EVENTS = [
    ("iex foo", "02-01-2024 03:04:05"),
    ("with attribute", "02-01-2024 03:04:05"),
    ("odd time", "weird"),
    ("no time", "N/D"),
    ("first", "02-01-2024 03:04:05"),
    ("second", "02-01-2024 03:04:05"),
    ("null", "02-01-2024 03:04:05"),
    ("single digits", "02-01-2024 03:04:05"),
    ("no such day", "2024-02-30 03:04:05"),
]


@pytest.mark.parametrize("one_per_line", [False, True])
def test_script_blocks(spark, tmp_path, one_per_line):
    broken = "<Event><System><EventID>4104</EventID></Sys"
    lines = ([*EVENTS[:3], broken, *EVENTS[3:]] if one_per_line
             else ["<Events>", *EVENTS, "</Events>"])
    path = put(tmp_path / "events.xml", "\n".join(lines).encode())
    rows = read_script_blocks(spark, path).orderBy("cmd_id").collect()
    assert [(r.command, r.timestamp) for r in rows] == EXPECTED_EVENTS
    assert {r.source for r in rows} == {"PS_Operational.evtx (EID 4104)"}
    assert rows[2].event_ts is None and rows[0].event_ts == datetime(2024, 1, 2, 3, 4, 5)


RUN = r"Software\Microsoft\Windows\CurrentVersion"
VALUES = [
    (RUN + r"\Run", "a", "cmd a"),
    (RUN.lower() + r"\runonce", "b", "cmd b"),
    (RUN + r"\Policies\Explorer\Run", None, "cmd c"),
    (RUN + r"\Run\Sub", "d", "powershell"),
    (r"Software\Foo", "long", "x" * 501),
    (r"Software\Foo", "short", "x" * 500),
    (r"SOFTWARE\Foo", "enc", "run -ENC abc"),
    (r"Software\Microsoft", "m", "iex"),
    (r"Software\Classes", "c", "iex"),
    (r"Software\microsoft", "case", "iex"),
    (r"Software\Foo\Bar", "deep", "iex"),
    (r"Environment\Foo", "env", "iex"),
    (r"Software", "root", "iex"),
]


def registry(spark, stamp=MOMENT.replace(tzinfo=None)):
    rows = [("h", key, stamp, name, data) for key, name, data in VALUES]
    return spark.createDataFrame(rows, REGISTRY_VALUE).coalesce(1)


def test_registry(spark):
    values = registry(spark)
    run = [(r.source, r.command) for r in persistence_entries(values).collect()]
    assert run == [
        ("Persistence Trigger (a)", "cmd a"), ("Persistence Trigger (b)", "cmd b"),
        ("Persistence Trigger ((default))", "cmd c"),
    ]
    stored = [r.source for r in storage_entries(values).collect()]
    assert stored == [
        "Suspicious Storage (Foo\\long)", "Suspicious Storage (Foo\\enc)",
        "Suspicious Storage (microsoft\\case)",
    ]
    both = registry_entries(values).collect()
    assert len(both) == len(run) + len(stored)
    assert {r.timestamp for r in both} == {"02-01-2024 03:04:05"}


def test_registry_times(spark):
    assert registry_entries(registry(spark, None)).first().timestamp == "N/D"
    as_text = registry(spark).withColumn(
        "key_ts", F.when(F.col("value_name") == "a", "soon").when(
            F.col("value_name") == "b", "2024-01-02 03:04:05").otherwise("")
    )
    shown = [r.timestamp for r in persistence_entries(as_text).collect()]
    assert shown == ["Timestamp Errato", "02-01-2024 03:04:05", "N/D"]


def test_shown_times(spark):
    texts = ["02-01-2024 03:04:05 (File)", "2-1-2024 3:4:5", "N/D", "31-02-2024 00:00:00", "weird"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    read = [r[0] for r in frame.select(times.shown_time(F.col("t"))).collect()]
    assert read == [datetime(2024, 1, 2, 3, 4, 5)] * 2 + [None] * 3


def test_scripts_and_hashes(spark, tmp_path):
    approved = "Get-Date\nGet-Item x\n"
    put(tmp_path / "a.ps1", approved.encode())
    put(tmp_path / "b.ps1", approved.replace("\n", "\r\n").encode())
    put(tmp_path / "c.ps1", approved.replace("\n", "\r").encode())
    put(tmp_path / "d.ps1", b"\xff")  # empty once the undecodable byte is gone
    put(tmp_path / "e.ps1", b"iex (amsiutils)")
    put(tmp_path / "f.ps1", b"git status")
    put(tmp_path / "g.ps1", b"")  # of length zero: its hash is the first on the built-in list
    put(tmp_path / "_hidden", b"")
    listed = hashlib.sha256(approved.encode()).hexdigest()
    trusted = spark.createDataFrame([(listed,), (listed,)], "sha256 string")
    scripts = read_scripts(spark, str(tmp_path))

    def names(frame):
        return sorted(os.path.basename(r.path) for r in frame.filter("is_trusted").collect())

    small = mark_trusted(scripts, trusted=trusted)
    large = mark_trusted(scripts, trusted=trusted, broadcast_rows=0)
    assert names(small) == names(large) == ["a.ps1", "b.ps1", "c.ps1"]
    assert small.count() == large.count() == 7
    assert names(mark_trusted(scripts)) == ["d.ps1", "g.ps1"]

    rows = {
        os.path.basename(r.path): r
        for r in check_scripts(scripts, trusted, base_score=F.lit(10.0)).collect()
    }
    assert len(rows) == 7
    assert os.path.basename(rows["e.ps1"].origin) == "e.ps1"
    assert rows["a.ps1"].reason == f"Hash SHA-256 approvato dal team IT ({listed[:8]}...)"
    assert rows["a.ps1"].score is None and not rows["a.ps1"].is_malicious
    assert rows["e.ps1"].score == 95.0 and rows["e.ps1"].level == "CRITICO"
    assert rows["f.ps1"].is_whitelisted and rows["f.ps1"].score == 0.0
    assert rows["a.ps1"].clean_cmd == "Get-Date Get-Item x"


def test_labelled_tables(spark, tmp_path):
    rows = [("7", "iex \"a\",\nb", 1), ("8", None, 0), ("x", "ls", 0)]
    frame = spark.createDataFrame(rows, "id string, command string, malicious int").coalesce(1)
    frame.write.parquet(str(tmp_path / "p"))
    frame.write.json(str(tmp_path / "j"))
    frame.write.option("header", "true").option("escape", '"').csv(str(tmp_path / "c"))
    for fmt, name in (("parquet", "p"), ("json", "j"), ("csv", "c")):
        read = read_labelled(spark, str(tmp_path / name), fmt)
        assert sorted(map(tuple, read.collect()), key=str) == sorted(rows, key=str)


def test_feature_table_round_trip(spark, tmp_path):
    from shellsieve.plans.train import build_dataset

    frame = spark.createDataFrame([("iex\x07 a", 1), (None, 0)], LABELLED_COMMAND)
    table = build_dataset(frame.withColumns({"id": F.lit("i"), "fold": F.lit(3)}))
    write_features(table, str(tmp_path / "f"))
    again = read_features(spark, str(tmp_path / "f"))
    assert again.columns == table.columns and len(again.columns) == 27
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))
    assert sorted(r.command for r in again.collect()) == ["", "iex a"]


def test_whole_texts_reach_the_features(spark):
    from shellsieve.plans.train import build_dataset

    frame = spark.createDataFrame([("x" * 33_000 + " iex", 1)], LABELLED_COMMAND)
    row = build_dataset(frame).first()
    assert row.has_iex == 1 and len(row.command) == 33_004


def test_preparation_differs_between_training_and_scan(spark):
    from shellsieve.plans.train import build_dataset

    frame = spark.createDataFrame([("a\n\n  b", 1)], LABELLED_COMMAND)
    assert build_dataset(frame).first().command == "a\n\n  b"
    assert build_dataset(frame, prepare="scan").first().command == "a b"
    with pytest.raises(KeyError):
        build_dataset(frame, prepare="other")


def test_union_of_sources(spark, tmp_path):
    history = read_history(spark, put(tmp_path / "h.txt", b"one\ntwo\none\n"))
    events = read_script_blocks(spark, put(tmp_path / "e.xml", EVENTS[0].encode()))
    values = registry_entries(registry(spark))
    union = combine_sources(history, events, values)
    assert union.count() == 3 + 1 + 6
    assert union.select("source_no", "cmd_id").distinct().count() == 10
    order = [r.source for r in union.orderBy("source_no", "cmd_id").collect()]
    assert order[:4] == ["Console_History"] * 3 + ["PS_Operational.evtx (EID 4104)"]
    assert {r.origin.rsplit("/", 1)[-1] for r in union.collect()} == {"h.txt", "host7", "h"}
    many = combine_sources(history, None, events, values, history, history, events)
    assert many.count() == 10 + 3 + 3 + 1
    assert many.select("source_no", "cmd_id").distinct().count() == many.count()
    ranked = find_malicious(many, base_score=F.lit(60.0))
    assert "origin" in ranked.columns and ranked.count() == many.count()
    assert combine_sources(None, events, None).count() == 1
    with pytest.raises(ValueError):
        combine_sources(None, None, None)
