"""Files cut at any byte: the same lines, records and values, in the same places."""

from contextlib import contextmanager

import pytest

from shellsieve.sources.history import read_history
from shellsieve.sources.positions import positioned_lines
from shellsieve.sources.registry import registry_entries
from shellsieve.sources import registry_export
from shellsieve.sources.registry_export import read_registry_export
from shellsieve.sources.script_blocks import read_event_xml, read_script_blocks
from test_sources import block, event


@contextmanager
def cut_every(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@pytest.mark.parametrize("size", [17, 1 << 20])
def test_lines_have_the_same_places_however_files_are_cut(spark, tmp_path, size):
    texts = {"a.txt": "".join(f"line {i} of a\n" for i in range(40)), "b.txt": "\nx\r\n\ny", "c.txt": "\ufeffwith mark\nsecond\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    with cut_every(spark, size):
        lines = positioned_lines(spark, str(tmp_path))
        assert (lines.select("origin", "block").distinct().count() > 20) == (size < 100)
        rows = sorted(lines.collect(), key=lambda r: r.place)
    expected = [(n, i, v) for n, t in texts.items() for i, v in enumerate(t.removesuffix("\n").encode().split(b"\n"))]
    assert [(r.origin.rsplit("/", 1)[1], r.line, bytes(r.value)) for r in rows] == expected
    assert [r.place for r in rows] == list(range(len(expected)))


def test_history_ids_hang_on_files_alone(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes("\ufeffGet-Date\r\n\r\nold\rmac\n".encode() + b"bad\xff byte\n" + b"ls -la\n" * 30)
    (tmp_path / "two.txt").write_bytes(b"last")
    found = []
    for size in (11, 1 << 20):
        with cut_every(spark, size):
            found.append([(r.cmd_id, r.command) for r in read_history(spark, str(tmp_path)).collect()])
    assert sorted(found[0]) == sorted(found[1])
    commands = [c for _, c in sorted(found[0])]
    assert commands == ["\ufeffGet-Date", "old", "mac", "bad byte", *["ls -la"] * 30, "last"]
    assert len({i for i, _ in found[0]}) == len(commands)


def test_a_file_of_many_ranges_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"Get-ChildItem -Recurse\n" * 200_000)
    with cut_every(spark, 1 << 18):
        entries = read_history(spark, str(tmp_path))
        assert entries.rdd.getNumPartitions() >= 16
        assert entries.count() == 200_000 and entries.select("cmd_id").distinct().count() == 200_000


def pretty(records):
    return '<?xml version="1.0"?>\n<Events>\n' + "\n".join(r.replace("><", ">\n  <") for r in records) + "\n</Events>\n"


def test_events_over_several_lines_are_cut_on_record_borders(spark, tmp_path):
    """A record that is not closed and one that is no XML stay alone."""
    good = [event(block(f"command {i}&#10;next")) for i in range(60)]
    broken = ["<Event><System><EventID>4104</EventID>", "<Event><System></Wrong></Event>"]
    records = good[:20] + broken[:1] + good[20:40] + broken[1:] + good[40:]
    (tmp_path / "events.xml").write_text(pretty(records))
    for size in (300, 1 << 20):
        with cut_every(spark, size):
            read = read_event_xml(spark, str(tmp_path))
            assert (read.rdd.getNumPartitions() > 20) == (size < 1000)
            got = sorted(r.command for r in read_script_blocks(spark, str(tmp_path)).collect())
        assert got == sorted(f"command {i} next" for i in range(60))


RUN = r"HKEY_CURRENT_USER\Software\Microsoft\Windows\CurrentVersion\Run"
EXPORT = rf"""Windows Registry Editor Version 5.00

[{RUN}]
"Upd\"ater"="C:\\Temp\\x.exe -enc \"abc\""
@="unnamed ü 😀"
"Gone"=-
"Empty"=hex:
"Number"=dword:0000001f
"Big"=hex(b):00,00,00,00,01,00,00,00
"Expand"=hex(2):69,00,\
  65,00,78,00,\
  20,00,78,00,00,00
"Many"=hex(7):61,00,00,00,27,00,62,00,00,00,00,00
"Raw"=hex:27,41,5c,00,ff,0a

[HKEY_CURRENT_USER\Software\Foo]
; a remark
"Script"="first line
iex second line

fourth"
"Short"="nothing"

[-HKEY_CURRENT_USER\Software\Bar]
[HKEY_USERS\S-1-5\Software\Baz]
"p"="powershell"
"""
EXPECTED = [
    ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", 'Upd"ater', 'C:\\Temp\\x.exe -enc "abc"'),
    ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", None, "unnamed ü 😀"),
    ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", "Empty", None),
    ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", "Number", str(0x1F)),
    ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", "Big", str(1 << 32)),
    ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", "Expand", "iex x"),
    ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", "Many", str(["a", "'b"])),
    ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", "Raw", str(b"'A\\\x00\xff\n")),
    ("Software\\Foo", "Script", "first line\niex second line\n\nfourth"),
    ("Software\\Foo", "Short", "nothing"),
    ("Software\\Baz", "p", "powershell"),
]


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_registry_exports(spark, tmp_path, size):
    """Headers, continued lines and values in different ranges, in both encodings."""
    text = EXPORT.replace("\n", "\r\n")
    (tmp_path / "wide.reg").write_bytes(text.encode("utf-16"))
    (tmp_path / "narrow.txt").write_bytes(text.encode())
    for name, encoding in (("wide.reg", "utf-16"), ("narrow.txt", "utf-8")):
        with cut_every(spark, size):
            rows = read_registry_export(spark, str(tmp_path / name), encoding).collect()
        got = sorted(((r.key_path, r.value_name, r.value_data) for r in rows), key=repr)
        assert got == sorted(EXPECTED, key=repr)
        assert {r.hive_id.rsplit("/", 1)[1] for r in rows} == {name, f"{name}#S-1-5"}
    with pytest.raises(ValueError):
        read_registry_export(spark, str(tmp_path), "latin")


@pytest.mark.parametrize("stretch", [100, 1 << 10])
def test_registry_ranges_hand_on_by_stretches(spark, tmp_path, monkeypatch, stretch):
    """Small stretches, several files and tasks by bytes: values do not change."""
    monkeypatch.setattr(registry_export, "STRETCH", stretch)
    monkeypatch.setattr(registry_export, "TASK_BYTES", 40)
    text = EXPORT.replace("\n", "\r\n")
    for n in range(3):
        (tmp_path / f"{n}.reg").write_bytes(text.encode("utf-16"))
    with cut_every(spark, 64):
        frame = read_registry_export(spark, str(tmp_path))
        rows = frame.collect()
    for n in range(3):
        got = [(r.key_path, r.value_name, r.value_data) for r in rows if f"{n}.reg" in r.hive_id]
        assert sorted(got, key=repr) == sorted(EXPECTED, key=repr)
    # texts of one letter are small in an exchange; their tasks are as many as their bytes ask for
    size = sum(f.stat().st_size for f in tmp_path.glob("*.reg"))
    assert frame.rdd.getNumPartitions() >= size * 0.9 // 40


def test_texts_of_an_export_are_joined_once(spark):
    lines = spark.createDataFrame([("a", 0, 0, b"[HKEY_USERS\\x]")], "origin string, block long, line long, value binary")
    plan = registry_export.export_values(lines, "utf-8")._jdf.queryExecution().optimizedPlan().toString()
    # the texts pass one exchange before they are grouped, not one for each thing carried
    assert plan.count("RepartitionByExpression") == 2
    joined = [j for j in plan.splitlines() if "Join LeftOuter" in j]
    assert len(joined) == 1


def test_entries_of_an_export(spark, tmp_path):
    (tmp_path / "hive.reg").write_bytes(EXPORT.encode("utf-16"))
    rows = {r.source: r.command for r in registry_entries(read_registry_export(spark, str(tmp_path))).collect()}
    assert rows["Persistence Trigger (Empty)"] == "None"
    assert rows["Persistence Trigger (Expand)"] == "iex x"
    assert rows["Suspicious Storage (Foo\\Script)"].startswith("first line\niex")
    assert rows["Suspicious Storage (Baz\\p)"] == "powershell"
    assert "Suspicious Storage (Foo\\Short)" not in rows
