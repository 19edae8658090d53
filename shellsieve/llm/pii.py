"""Personal data: patterns, and a skip-chain conditional random field around them.

Patterns find the base spans.  The field then labels the other tokens of a document that
hold a digit or an at sign with a kind or with none.  Its factors are

* a token factor, multinomial logistic on the token's shape and its neighbours' shapes;
* a chain factor between tokens that follow each other;
* a skip factor between distant tokens that repeat or resemble each other: the same
  letters and digits, the same last seven digits, the same half of a long number.

Tokens inside base spans are observed.  Loopy sum-product message passing over
chain and skip edges makes labels agree across the document, so the bare second mention of
a phone number gets the label of the first.  Tokens that resemble each other hang on one
hub variable each, so a token repeated ``n`` times has ``n`` skip edges, not ``n`` squared.
A span is added where the belief in a kind is at least ``BELIEF`` and the token hangs, over
hubs, on an observed token of that kind: shape alone adds nothing.

The factors are trained piece by piece on the base spans of the corpus: Spark counts shape
combinations, chain pairs and skip pairs over all documents, which are tables of a fixed
size, and numpy fits the weights to the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.spans import Found, annotate, ordered

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
BELIEF = 0.5
ROUNDS = 12
#: smoothing of the pair factors: that many pairs, of which this share agrees
PSEUDO, AGREEMENT = 20.0, 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_EDGES = ".,;:!?\"'<>[]{}|"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, in time linear in the text: each needs its own @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern findings, leftmost and non-overlapping per kind."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text)
                  if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


class Tokens:
    """Tokens of one text that hold a digit or an at sign, with labels from the base spans."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]]):
        self.at, self.label, self.entity = [], [], []
        inside = sorted(spans, key=lambda s: (s[1], -s[2]))
        k, reach = 0, []
        for m in _TOKEN.finditer(text):
            raw = m[0]
            a = m.start() + len(raw) - len(raw.lstrip(_EDGES))
            b = max(a, m.end() - (len(raw) - len(raw.rstrip(_EDGES))))
            if b == a:
                continue
            while k < len(inside) and inside[k][1] < b:
                reach.append(inside[k])
                k += 1
            reach = [s for s in reach if s[2] > a]
            self.at.append((a, b))
            self.label.append(LABELS.index(reach[0][0]) if reach else 0)
            self.entity.append(reach[0] if reach else None)
        self.text = text

    def shapes(self) -> list[tuple[int, ...]]:
        """A few small categories per token: digits, dots, signs, letters, and neighbours'."""
        own = []
        for a, b in self.at:
            t = self.text[a:b]
            digits = sum(map(t.count, "0123456789"))
            size = 0 if not digits else 1 + (digits > 3) + (digits > 6) + (digits > 8) + (digits > 11) + (digits > 19)
            own.append((size, min(t.count("."), 4), int(t[0] == "+"), int("(" in t), int("-" in t),
                        int("@" in t), int(any(map(str.isalpha, t)))))
        out = []
        for i, shape in enumerate(own):
            side = []
            for j in (i - 1, i + 1):
                near = 0 <= j < len(own) and self._gap(min(i, j)) <= 2
                side.append(1 + (own[j][0] > 2) if near else 0)
            out.append((*shape, *side))
        return out

    def _gap(self, i: int) -> int:
        return self.at[i + 1][0] - self.at[i][1]

    def chain(self) -> list[int]:
        """Tokens that the next one follows directly."""
        return [i for i in range(len(self.at) - 1) if self._gap(i) <= 2]

    def hubs(self) -> list[tuple[int, str]]:
        """Token and hub name for every likeness; hubs of a single token are left out."""
        named = []
        for i, (a, b) in enumerate(self.at):
            for name in _likeness(self.text[a:b], self.entity[i], self.text):
                named.append((i, name))
        n = Counter(name for _, name in named)
        return [(i, name) for i, name in named if n[name] > 1]


def _likeness(token: str, entity: tuple[str, int, int] | None, text: str) -> set[str]:
    whole = text[entity[1]:entity[2]] if entity else token
    digits = "".join(_DIGIT.findall(whole))
    own = "".join(_DIGIT.findall(token))
    core = "".join(c for c in token.lower() if c.isalnum())
    names = set()
    if len(core) >= 5:
        names.add(f"core {core}")
    if "@" in token:
        local = "".join(c for c in token.split("@")[0].lower() if c.isalnum())
        if len(local) >= 5:
            names.add(f"core {local}")
    if len(own) >= 7 or (entity and len(digits) >= 7):
        names.add(f"tail {digits[-7:] if entity else own[-7:]}")
    for d in {own, digits}:
        if 9 <= len(d) <= 19:
            half = len(d) // 2
            names |= {f"head {len(d)} {d[:half]}", f"rest {len(d)} {d[half:]}"}
    return names


def _counted(texts: list[str]) -> Counter:
    """Training counts of some texts: shapes by label, label pairs along chains and over hubs."""
    counts: Counter = Counter()
    for text in texts:
        spans = base_spans(text)
        tokens = Tokens(text, spans)
        for shape, label in zip(tokens.shapes(), tokens.label, strict=True):
            counts["shape", *shape, label] += 1
        for i in tokens.chain():
            counts["chain", tokens.label[i], tokens.label[i + 1]] += 1
        last: dict[str, int] = {}
        for i, name in tokens.hubs():
            if name in last:
                counts["skip", tokens.label[last[name]], tokens.label[i]] += 1
            last[name] = i
    return counts


class Field:
    """Trained factors: token weights, chain and skip tables."""

    def __init__(self, counts: dict[tuple, int]):
        shapes = [(k[1:-1], k[-1], n) for k, n in counts.items() if k[0] == "shape"]
        self.values = sorted({(i, v) for shape, _, _ in shapes for i, v in enumerate(shape)})
        self.place = {value: i for i, value in enumerate(self.values)}
        self.weights = np.zeros((len(self.values) + 1, len(LABELS)))
        self._fit(shapes)
        self.chain = self._affinity(counts, "chain")
        self.skip = self._affinity(counts, "skip")

    def _rows(self, shapes) -> np.ndarray:
        x = np.zeros((len(shapes), len(self.values) + 1))
        x[:, -1] = 1
        for row, shape in enumerate(shapes):
            for value in enumerate(shape):
                if value in self.place:
                    x[row, self.place[value]] = 1
        return x

    def _fit(self, shapes, steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> None:
        """Gradient ascent on the weighted log-likelihood, with momentum."""
        if not shapes:
            return
        x = self._rows([s for s, _, _ in shapes])
        n = np.array([n for _, _, n in shapes], float)
        y = np.eye(len(LABELS))[[label for _, label, _ in shapes]]
        n /= n.sum()
        speed = np.zeros_like(self.weights)
        for _ in range(steps):
            logits = x @ self.weights
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed + x.T @ (n[:, None] * (y - p)) - ridge * self.weights
            self.weights += rate * speed

    def _affinity(self, counts: dict[tuple, int], piece: str) -> np.ndarray:
        """Log odds of a label given its neighbour's, against its share among all tokens.

        Conditional shares are smoothed towards agreement, which stands for label pairs that
        the corpus does not show.
        """
        size = len(LABELS)
        n, share = np.zeros((size, size)), np.ones(size)
        for k, c in counts.items():
            if k[0] == piece:
                n[k[1], k[2]] += c
                n[k[2], k[1]] += c
            elif k[0] == "shape":
                share[k[-1]] += c
        agree = np.full((size, size), (1 - AGREEMENT) / (size - 1))
        np.fill_diagonal(agree, AGREEMENT)
        given = (n + PSEUDO * agree) / (n.sum(1, keepdims=True) + PSEUDO)
        odds = np.log(given / (share / share.sum())[None, :])
        return np.clip((odds + odds.T) / 2, -4, 4)

    def token_factors(self, tokens: Tokens) -> np.ndarray:
        logits = self._rows(tokens.shapes()) @ self.weights
        return logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)

    def beliefs(self, tokens: Tokens, hubs: list[tuple[int, str]]) -> np.ndarray:
        """Label probabilities of the tokens after message passing; observed tokens stay."""
        names = {name: len(tokens.at) + j for j, name in enumerate(dict.fromkeys(name for _, name in hubs))}
        n, size = len(tokens.at), len(tokens.at) + len(names)
        factor = np.zeros((size, len(LABELS)))
        factor[:n] = self.token_factors(tokens)
        for i, label in enumerate(tokens.label):
            if label:  # observed
                factor[i] = -50.0
                factor[i, label] = 0.0
        chain = tokens.chain()
        a = np.array(chain + [i for i, _ in hubs], np.int64)
        b = np.array([i + 1 for i in chain] + [names[name] for _, name in hubs], np.int64)
        tables = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(hubs), 0)])
        source, target = np.r_[a, b], np.r_[b, a]
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            total = factor.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            new = np.logaddexp.reduce(out[:, :, None] + tables, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        total = factor.copy()
        np.add.at(total, target, message)
        total = total[:n]
        return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))


def train_field(docs: DataFrame, text: str = "text") -> Field:
    """Factors from the base spans of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                counts += _counted([t or "" for t in batch.column(0).slice(at, 256).to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(map(str, k)) for k in counts], pa.list_(pa.string())),
             pa.array(counts.values(), pa.int64())], ["k", "n"])

    held = F.col(text).rlike("[0-9@]")
    rows = (
        docs.filter(held).select(text).mapInArrow(run, "k array<string>, n bigint")
        .groupBy("k").agg(F.sum("n").alias("n")).collect()  # bounded by the shape categories
    )
    return Field({(r.k[0], *map(int, r.k[1:])): r.n for r in rows})


def find_personal(text: str, field: Field) -> list[Found]:
    """Base spans, and those that the field adds to a text that has some."""
    base = base_spans(text)
    found = {s: True for s in base}
    if base:
        tokens = Tokens(text, base)
        hubs = tokens.hubs()
        kinds: dict[str, set[int]] = {}
        for i, name in hubs:
            kinds.setdefault(name, set()).add(tokens.label[i])
        allowed: dict[int, set[int]] = {}
        for i, name in hubs:
            if not tokens.label[i]:
                allowed.setdefault(i, set()).update(kinds[name] - {0})
        allowed = {i: k for i, k in allowed.items() if k}
        if allowed:
            belief = field.beliefs(tokens, hubs)
            for i, labels in allowed.items():
                best = max(labels, key=lambda k: belief[i, k])
                if belief[i, best] >= BELIEF:
                    found.setdefault((LABELS[best], *tokens.at[i]), False)
    return ordered([(*s, own, "" if own else "skip-chain") for s, own in found.items()], KINDS)


def find_pii(docs: DataFrame, field: Field | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base, via): personal data of every whole text.

    Offsets are code points, ends exclusive; ``base`` spans are the patterns', the others
    those of the field (trained on ``docs`` unless given).  Null and empty texts have no
    spans; ids may be null or repeat; other columns are not read; an empty table trains a
    field without evidence and gives an empty result.
    """
    field = field or train_field(docs, text)
    return annotate(docs, lambda texts: [find_personal(t, field) for t in texts], text, doc_id)
