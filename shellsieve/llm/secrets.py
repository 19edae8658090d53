"""Secrets in texts and in what is encoded inside them.

A text is the first entry of a worklist.  Every entry is scanned for secrets; then its
lines with URL or Unicode escapes, its base64 runs and what these hold compressed are
unwrapped into new entries, until nothing unwraps any more.  An entry that was seen before
at the same place is not taken again, so self-reproducing layers end.  Every character of
an entry knows which part of the document it stems from, and a finding in a layer is
reported as that span.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame

from shellsieve.llm.spans import Found, annotate, ordered

KINDS = ("assign", "access", "hex")
#: A compressed layer is held whole up to here; a larger one is read in overlapping pieces.
LAYER_BYTES, PIECE_BYTES, OVERLAP_BYTES = 16 << 20, 8 << 20, 1 << 20

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}"
                      r"|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
_BASE64_URL = re.compile(r"[A-Za-z0-9_-]{16,}={0,2}")
_MORE, _MORE_URL = re.compile(r"[A-Za-z0-9+/]+={0,2}"), re.compile(r"[A-Za-z0-9_-]+={0,2}")
_LINE_END = re.compile(r"[ \t]*\r?\n[ \t]*")
_WRITTEN_END = re.compile(r"\\[nrt]")
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY")
#: bytes written as URL escapes, with those that need none
_URL_BYTES = re.compile(r"(?<![A-Za-z0-9_.~+/-])[A-Za-z0-9_.~+/-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~+/-]*+){8,}+")
_HEX_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){8,}")
#: Twelve characters are the shortest finding.
_READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
_READABLE_16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings in one text, leftmost and non-overlapping per kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """Text, and for each of its characters the range of the document it stems from."""

    def __init__(self, text: str, lo: Sequence[int], hi: Sequence[int], via: str):
        self.text, self.lo, self.hi, self.via = text, lo, hi, via

    def key(self) -> tuple:
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return digest, self.lo[0], self.hi[-1]


def _unescaped_url(token: str) -> list[tuple[str, int, int]]:
    """Characters of a run of percent escapes, with their ranges in it; bad bytes stay out."""
    data = bytes.fromhex(token.replace("%", ""))
    out, at = [], 0
    while at < len(data):
        size = 1 if data[at] < 0x80 else 2 if data[at] >> 5 == 6 else 3 if data[at] >> 4 == 14 else 4
        try:
            out.append((data[at:at + size].decode(), 3 * at, 3 * (at + size)))
        except UnicodeDecodeError:
            size = 1
            out.append(("\ufffd", 3 * at, 3 * at + 3))
        at += size
    return out


def _unescaped_unicode(token: str) -> list[tuple[str, int, int]]:
    if token[0] == "\\" and token[1] == "u" and token[2] != "{":
        units = [int(token[i + 2:i + 6], 16) for i in range(0, len(token), 6)]
        out, i = [], 0
        while i < len(units):
            size = 2 if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000 else 1
            raw = b"".join(u.to_bytes(2, "big") for u in units[i:i + size])
            out.append((raw.decode("utf-16-be", "replace"), 6 * i, 6 * (i + size)))
            i += size
        return out
    code = int(token[2:-1]) if token[0] == "&" and token[2] not in "xX" else int(token.strip("&#x;\\Uu{}X"), 16)
    good = code <= 0x10FFFF and not 0xD800 <= code < 0xE000
    return [(chr(code) if good else "\ufffd", 0, len(token))]


def _escapes(layer: Layer, pattern: re.Pattern, decode, name: str) -> list[Layer]:
    """Each line with escapes, read without them: what stands around them is its context."""
    text, out = layer.text, []
    tokens = list(pattern.finditer(text))
    at = 0
    while at < len(tokens):
        start = text.rfind("\n", 0, tokens[at].start()) + 1
        end = text.find("\n", tokens[at].end())
        end = len(text) if end < 0 else end
        chars, lo, hi, here = [], [], [], start
        while at < len(tokens) and tokens[at].start() < end:
            m = tokens[at]
            chars.append(text[here:m.start()])
            lo += layer.lo[here:m.start()]
            hi += layer.hi[here:m.start()]
            for c, a, b in decode(m[0]):
                chars.append(c)
                lo += [layer.lo[m.start() + a]] * len(c)
                hi += [layer.hi[m.start() + b - 1]] * len(c)
            here = m.end()
            at += 1
        chars.append(text[here:end])
        lo += layer.lo[here:end]
        hi += layer.hi[here:end]
        if lo:
            out.append(Layer("".join(chars), lo, hi, f"{layer.via}>{name}".lstrip(">")))
    return out


def _is_raw(data: bytes) -> bool:
    stream = zlib.decompressobj(wbits=-15)
    try:
        out = stream.decompress(data, LAYER_BYTES)
    except zlib.error:
        return False
    return len(out) > 12 and (stream.eof or bool(stream.unconsumed_tail))


class _Same:
    """A sequence of one value: every character of a compressed layer stems from all of it."""

    def __init__(self, value: int, size: int):
        self.value, self.size = value, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        return [self.value] * len(range(*at.indices(self.size))) if isinstance(at, slice) else self.value


def _decompressor(data: memoryview, raw: bool):
    head = bytes(data[:10])
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 2 and head[1:2] in b"\x01\x5e\x9c\xda"):
        return zlib.decompressobj(wbits=47)
    if _STREAM.match(head):
        return bz2.BZ2Decompressor()
    return zlib.decompressobj(wbits=-15) if raw else None


def _inflating(data: bytes | memoryview, raw: bool = False) -> Iterator[bytes]:
    """What a gzip, zlib or bzip2 stream (or a raw one) holds, a piece at a time.

    The members of a stream of several follow each other.  A stream that breaks off gives
    what it holds until there; bytes that are no stream give nothing.
    """
    rest = memoryview(data)
    while len(rest) and (stream := _decompressor(rest, raw)) is not None:
        given = rest
        while not stream.eof:
            try:
                out = stream.decompress(given, PIECE_BYTES)
            except (zlib.error, OSError, EOFError):
                return
            if out:
                yield out
            given = getattr(stream, "unconsumed_tail", b"")
            if not out and not given:
                break
        if not stream.eof or raw:
            return
        rest = memoryview(stream.unused_data)


def _inflated(data: bytes | memoryview, raw: bool = False) -> tuple[bytes, Iterator[bytes]] | None:
    """The first ``LAYER_BYTES`` of a stream and what follows; None if there is none."""
    pieces, out = _inflating(data, raw), []
    for piece in pieces:
        out.append(piece)
        if sum(map(len, out)) > LAYER_BYTES:
            break
    whole = b"".join(out)
    return (whole, pieces) if whole else None


def _whole_signs(data: bytes) -> bytes:
    """Bytes without the parts of UTF-8 signs that a cut left at their ends."""
    begin = next((i for i in range(min(4, len(data))) if data[i] & 0xC0 != 0x80), 0)
    end = len(data)
    for i in range(1, min(4, len(data)) + 1):
        lead = data[-i]
        if lead & 0xC0 != 0x80:
            need = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4
            end = len(data) - i if need > i else end
            break
    return data[begin:end]


def _texts_of(first: bytes, more: Iterator[bytes]) -> Iterator[str]:
    """A layer as text; a large one in pieces, each with the end of the piece before."""
    piece = next(more, b"")
    if not piece:
        if (text := _as_text(first)) is not None:
            yield text
        return
    held = first
    while held:
        if (text := _as_text(_whole_signs(held))) is not None:
            yield text
        held = held[-OVERLAP_BYTES:] + piece if piece else b""
        piece = next(more, b"")


def _as_text(data: bytes) -> str | None:
    """Bytes as text, if they read as one: UTF-8, or UTF-16LE of mostly Latin letters."""
    if len(data) >= 4 and data[1::2].count(0) * 4 >= 3 * len(data[1::2]):
        try:
            text = data.decode("utf-16-le")
        except UnicodeDecodeError:
            return None
    else:
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return None
    seen = sum(c.isprintable() or c in "\t\n\r" for c in text)
    return text if text and seen * 20 >= 19 * len(text) else None


def _joined(text: str, pattern: re.Pattern, more: re.Pattern) -> Iterator[tuple[str, Sequence[int]]]:
    """Runs of base64 and where each digit stands; lines of equal length are one run.

    The first line may be of another length, as something may stand before it, and the last
    may be shorter.
    """
    done = 0
    for m in pattern.finditer(text):
        if m.start() < done:
            continue
        parts, full, at = [m.span()], 0, m.end()
        while text[at - 1] != "=" and (gap := _LINE_END.match(text, at)) and (n := more.match(text, gap.end())):
            size = n.end() - n.start()
            if full and size > full:
                break
            parts.append(n.span())
            full, at = full or size, n.end()
            if size < full:
                break
        done = at
        digits = "".join(text[a:b] for a, b in parts).rstrip("=")
        where = range(m.start(), m.end()) if len(parts) == 1 else [i for a, b in parts for i in range(a, b)]
        yield digits, where


def _holds(data: bytes, whole: bool, how: str = "base64") -> Iterator[tuple[str, Sequence[int] | None, str]]:
    """Texts inside decoded bytes, the byte of each character (None: of all), and how it is held.

    If the bytes as a whole are no text and no stream, the streams and the readable parts
    that lie among others are taken: what precedes a run was decoded along with it.
    """
    view = memoryview(data)
    stream = bool(_STREAM.match(data)) and _inflated(data) is not None
    begins = [0] if stream else [m.start() for m in _STREAM.finditer(data)]
    # Raw deflate has no mark, so only a stream that ends, or goes on beyond a layer, is one.
    raw = whole and not stream and _is_raw(data)
    for begin in [-1] * raw + begins:
        inside, via, passed = view[max(begin, 0):], how, set()
        while (inner := _inflated(inside, raw=begin < 0 and via == how)) is not None:  # perhaps more than once
            inside, more = inner
            via = f"{via}>compressed"
            mark = hashlib.blake2b(inside, digest_size=16).digest()
            if mark in passed:
                break
            passed.add(mark)
            if not _STREAM.match(inside):
                for text in _texts_of(inside, more):
                    yield text, None, via
                break
    if stream:
        return
    found = _as_text(data) if whole else None
    if found is not None:
        yield found, range(len(data)) if len(found) == len(data) else None, how
        return
    for m in _READABLE.finditer(data):
        try:
            found = m[0].decode()
        except UnicodeDecodeError:
            continue
        at = [m.start() + i for i, v in enumerate(m[0]) if v & 0xC0 != 0x80]
        yield found, at, how
    for m in _READABLE_16.finditer(data):
        yield m[0].decode("utf-16-le"), range(m.start(), m.end(), 2), how


def _base64(layer: Layer) -> list[Layer]:
    """What base64 runs hold, read from each of their first four digits."""
    out, texts = [], [layer.text]
    if "\\" in layer.text:  # the letter of a written-out line end is no digit
        texts.append(_WRITTEN_END.sub(" \n", layer.text))
    runs = {}
    for text in texts:
        for pattern, more in ((_BASE64, _MORE), (_BASE64_URL, _MORE_URL)):
            for digits, where in _joined(text, pattern, more):
                if pattern is _BASE64 or "-" in digits or "_" in digits:
                    runs.setdefault((where[0], digits), where)
    for (_, run), where in runs.items():
        for off in range(4):
            digits = run[off:]
            digits = digits[: len(digits) - (len(digits) % 4 == 1)]
            try:
                data = base64.b64decode(
                    digits.replace("-", "+").replace("_", "/") + "=" * (-len(digits) % 4), validate=True)
            except binascii.Error:
                continue
            last = off + len(digits) - 1
            for found, at, via in _holds(data, off == 0):
                if at is not None:  # exact ranges
                    ends = [*at[1:], at[-1] + (at[1] - at[0] if len(at) > 1 else 1)]
                    lo = [layer.lo[where[off + i * 4 // 3]] for i in at]
                    hi = [layer.hi[where[min(last, off + (i * 4 + 3) // 3 - 1)]] for i in ends]
                else:
                    lo, hi = _Same(layer.lo[where[off]], len(found)), _Same(layer.hi[where[last]], len(found))
                out.append(Layer(found, lo, hi, f"{layer.via}>{via}".lstrip(">")))
    return out


def _escaped_bytes(layer: Layer, pattern: re.Pattern, decode, name: str) -> list[Layer]:
    """Streams among bytes that are written as escapes."""
    out = []
    for m in pattern.finditer(layer.text):
        data = decode(m[0])
        if not _STREAM.search(data):
            continue
        lo, hi = layer.lo[m.start()], layer.hi[m.end() - 1]
        for found, _, via in _holds(data, False, name):
            if via != name:
                out.append(Layer(found, _Same(lo, len(found)), _Same(hi, len(found)), f"{layer.via}>{via}".lstrip(">")))
    return out


def unwrapped(layer: Layer) -> list[Layer]:
    out = []
    if "%" in layer.text:
        out += _escaped_bytes(layer, _URL_BYTES, unquote_to_bytes, "url")
    if "\\x" in layer.text:
        out += _escaped_bytes(layer, _HEX_BYTES, lambda t: bytes.fromhex(t.replace("\\x", "")), "unicode")
    if "%" in layer.text:
        out += _escapes(layer, _URL, _unescaped_url, "url")
    if "\\" in layer.text or "&#" in layer.text:
        out += _escapes(layer, _UNICODE, _unescaped_unicode, "unicode")
    return out + _base64(layer)


def find_secrets(text: str) -> list[Found]:
    """All findings of one text: base spans, and those of layers by where they stem from."""
    spans = {s: (True, "") for s in base_spans(text)}
    work = [Layer(text, range(len(text)), range(1, len(text) + 1), "")]
    seen = set()
    while work:
        layer = work.pop()
        for inner in unwrapped(layer):
            key = inner.key()
            if key in seen:
                continue
            seen.add(key)
            for kind, a, b in base_spans(inner.text):
                spans.setdefault((kind, inner.lo[a], inner.hi[b - 1]), (False, inner.via))
            work.append(inner)
    return ordered([(*s, *how) for s, how in spans.items()], KINDS)


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base, via): secrets of every whole text.

    Offsets are code points, ends exclusive.  ``base`` spans stand in the text itself;
    others stand in unwrapped layers, named in ``via`` from the outside in, and cover the
    encoded characters.  A finding that a layer shows at the place of an equal one is
    reported once.  Null and empty texts have no spans; ids may be null or repeat; other
    columns are not read; an empty table gives an empty one.  A compressed layer of any
    size is read; beyond ``LAYER_BYTES`` in pieces that overlap by ``OVERLAP_BYTES``, so a
    finding or an inner run longer than the overlap may be seen in parts there.
    """
    return annotate(docs, lambda texts: [find_secrets(t) for t in texts], text, doc_id)
