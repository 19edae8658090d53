import base64
import bz2
import gzip
import re
import time
import zlib
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shellsieve.llm import secrets
from shellsieve.llm.spans import digest

SECRET = "password=hunter22secret"


def plain(text):
    out = [("assign", *m.span()) for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Token", "api_Key", "\"", "'", " ", ":", "=", "abc123", "AKIA", "Z" * 9, "f" * 13, "é", "\n", "ſecret"])).map("".join))
def test_base_spans_follow_the_patterns(text):
    assert sorted(secrets.base_spans(text)) == plain(text)


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def escaped(text):
    return "".join(f"\\u{ord(c):04x}" for c in text)


def percent(text):
    return "".join(f"%{b:02X}" for b in text.encode())


LAYERS = {
    "base64": (b64(SECRET), "base64"),
    "base64 for URLs": (base64.urlsafe_b64encode(("???>>>" + SECRET).encode()).decode().rstrip("="), "base64"),
    "url": (percent(SECRET), "url"),
    "unicode": (escaped(SECRET), "unicode"),
    "gzip": (b64(gzip.compress(SECRET.encode(), mtime=0)), "base64>compressed"),
    "zlib": (b64(zlib.compress(SECRET.encode())), "base64>compressed"),
    "twice": (b64(b64(SECRET)), "base64>base64"),
    "url in base64": (b64(quote(SECRET, safe="")), "base64>url"),
    "base64 in url": (percent(b64(SECRET)), "url>base64"),
    "four": (percent(b64(gzip.compress(escaped(SECRET).encode(), mtime=0))), "url>base64>compressed>unicode"),
    "utf-16": (b64(SECRET.encode("utf-16-le")), "base64"),
    "entities": ("".join(f"&#{ord(c)};" for c in SECRET), "unicode"),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers_are_unwrapped_and_mapped(name):
    token, via = LAYERS[name]
    text = f"é some words before {token} and after"
    hits = [s for s in secrets.find_secrets(text) if s[0] == "assign" and not s[3]]
    assert hits, name
    _, a, b, _, how = hits[0]
    start = text.index(token)
    assert start <= a < b <= start + len(token) + 1
    assert how == via


@pytest.mark.parametrize("before", ["/files/", "files/a/", "\\n", "q", "ab", "abc", "some/longer/path1/"])
@pytest.mark.parametrize("held", [SECRET, gzip.compress(SECRET.encode(), mtime=0), SECRET.encode("utf-16-le")])
def test_runs_begin_anywhere(before, held):
    token = b64(held)
    text = f"see {before}{token} there"
    hits = [s for s in secrets.find_secrets(text) if s[0] == "assign" and not s[3]]
    assert hits and all(4 <= a < b <= len(text) - 6 for _, a, b, *_ in hits)


@pytest.mark.parametrize("columns", [64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\\n"])
@pytest.mark.parametrize("packed", [False, True])
def test_wrapped_runs_are_one(columns, end, packed):
    inner = " ".join(f"word{i * 7919 % 1000}" for i in range(40)) + " " + SECRET + " and more words"
    for shift in range(0, 60, 7):
        token = b64(gzip.compress(("x" * shift + inner).encode(), mtime=0) if packed else "x" * shift + inner)
        lines = end.join(token[i:i + columns] for i in range(0, len(token), columns))
        text = f"head:{end}{lines}{end}tail of it"
        hits = [s for s in secrets.find_secrets(text) if s[0] == "assign" and not s[3]]
        assert any(b - a >= len(SECRET) for _, a, b, *_ in hits)
        if not packed:
            kept = text[min(h[1] for h in hits):max(h[2] for h in hits)].replace(end, "")
            assert len(kept) <= len(b64(SECRET)) + 4


def test_exact_ranges():
    text = f"x {percent('token=')}abcdefgh y"
    assert [s[1:3] for s in secrets.find_secrets(text) if s[0] == "assign"] == [(2, 2 + 18 + 8)]
    inner = "some words, then " + SECRET
    text = "pre " + b64(inner)
    (_, a, b, *_), = [s for s in secrets.find_secrets(text) if s[0] == "assign"]
    assert a == 4 + 17 * 4 // 3 and b >= len(text.rstrip("=")) - 1


def test_plain_text_gives_base_spans_only():
    text = "Handesenstionthereaboutsandmore words of twenty letters: abcdefghijklmnopqrstuvwx and 100%25 of it"
    assert secrets.find_secrets(text) == [(*s, True, "") for s in plain(text)]


def test_cycles_and_bombs_end(monkeypatch):
    assert secrets.find_secrets(b64(zlib.compress(b"z" * (1 << 22)))) == []
    text = "%25" * 300 + "41"
    assert secrets.find_secrets(text) == []
    monkeypatch.setattr(secrets, "_inflated", lambda data, raw=False: (bytes(data), iter(())))
    assert secrets.find_secrets(b64(b"\x78\x9c self reproducing")) == []


def test_edge_rows(edge, edge_rows):
    out = digest(secrets.scan_secrets(edge), secrets.KINDS).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted((d for d, _ in edge_rows), key=repr)
    assert all(r.spans == "" for r in out)
    assert secrets.scan_secrets(edge.limit(0)).count() == 0


def test_query_equals_plain_patterns(spark):
    import hashlib

    from shellsieve.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = 0
    for r in QUERIES["op9_nested_secrets"](spark, folder).collect():
        base = sorted(plain(texts[r.doc_id] or ""), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(base)
        found += len(base)
    assert found


def found_in(text):
    return {(k, via) for k, a, b, base, via in secrets.find_secrets(text) if not base}


def encoded(data):
    return base64.b64encode(data).decode()


def test_a_layer_of_any_size_is_read():
    """65 MB and 40 MB unpacked, the secret at the end and across a border of pieces."""
    for size in (65 << 20, (16 << 20) + 100):
        data = b"x " * (size // 2) + SECRET.encode()
        assert found_in(encoded(gzip.compress(data))) == {("assign", "base64>compressed")}


def test_members_raw_streams_and_bzip2():
    two = gzip.compress(b"nothing in the first member") + gzip.compress(SECRET.encode())
    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(f"some text, then {SECRET} and more".encode()) + raw.flush()
    for data in (two, deflated, bz2.compress(SECRET.encode()), zlib.compress(bz2.compress(SECRET.encode()))):
        assert "assign" in {k for k, via in found_in(encoded(data)) if "compressed" in via}


def test_streams_written_as_escapes():
    data = gzip.compress(SECRET.encode())
    assert found_in("get /?q=" + quote(data)) == {("assign", "url>compressed")}
    assert found_in("b'" + "".join(f"\\x{b:02x}" for b in data) + "'") == {("assign", "unicode>compressed")}


def test_time_grows_with_the_text():
    """Candidates of streams are looked at in place: four times the text is not ten times the time."""
    unit = encoded(bytes(range(256)) * 64 + b"\x78\x9c" * 64)
    took = []
    for n in (4, 16):
        start = time.perf_counter()
        secrets.find_secrets(unit.rstrip("=") * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0]
