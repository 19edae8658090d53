import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from conftest import CLASHES
from shellsieve.llm.listrank import list_ranks, placed
from shellsieve.llm.trie import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, every=20):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, told, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        built = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            nodes.setdefault(built[:d], []).append((c, d == len(built)))
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = {q for q in below if len(q) == len(p) + 1}
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        ends = ",".join(map(str, sorted(c for c, last in members if last)))
        out.append((min(members)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(members), len(children),
                    leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(frame, **options):
    return sorted(map(tuple, prefix_trie(frame, **options).select(*COLUMNS).collect()), key=repr)


def test_equals_listing_prefixes(spark):
    """Shared beginnings, repeated and null turns, ids below zero, windows of two turns, splicing down to four arcs."""
    rng = random.Random(3)
    rows = []
    for c in [*range(-25, 60), None]:
        for _ in range(rng.randint(0, 6)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "bot", None]), rng.choice(["hi you", "", "a  b\tc", None, "é"])))
    rows += rows[:5]
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = frame.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    assert found(extra, block=2, most=64) == plain(rows)


def test_tour_places_and_empty_table(spark):
    rows = [(1, 0, "u", "x"), (2, 0, "u", "x"), (2, 1, "u", "y")]
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA)).select("enter", "leave").collect()
    places = sorted(p for r in got for p in r)
    assert places == list(range(2 * len(got)))
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_list_ranks_are_sums_before(spark):
    order = list(range(500))
    random.Random(1).shuffle(order)
    links = [(a, b, 1, a % 7) for a, b in zip(order, [*order[1:], None])]
    got = list_ranks(spark.createDataFrame(links, "arc long, next long, place long, w long"), order[0], ("place", "w"), most=100)
    sums, run = {}, 0
    for i, a in enumerate(order):
        sums[a], run = (i, run), run + a % 7
    assert {r.arc: (r.place, r.w) for r in got.collect()} == sums


def test_places_follow_the_order(spark):
    frame = spark.range(1000).select((F.col("id") % 10).alias("a"), F.lit(7).alias("b"), "id")
    rows = placed(frame, "a", "b").collect()
    assert sorted(r.place for r in rows) == list(range(1000))
    assert [r.a for r in sorted(rows, key=lambda r: r.place)] == sorted(r.a for r in rows)
