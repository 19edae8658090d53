import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shellsieve.llm import decontaminate as d
from shellsieve.llm.tokens import buffers


def shingles(text, width):
    """Shingle hashes of a text, taken one by one."""
    words = d.words_of(*buffers(pa.array([text])))
    hashes = words.hashes().tolist()
    return [tuple(hashes[i:i + width]) for i in range(len(hashes) - width + 1)], len(hashes)


def plain(rows, items, width=5, least=0.8):
    """Best similarity of each item over every window of every document."""
    out = {}
    for doc_id, text in rows:
        for item, passage in items:
            n = shingles(passage or "", 1)[1]
            if not n or item is None:
                continue
            w = min(width, n)
            own, _ = shingles(passage, w)
            doc, _ = shingles(text or "", w)
            m = min(len(own), len(doc))
            bag, best = Counter(own), 0.0
            for s in range(len(doc) - m + 1):
                both = sum((bag & Counter(doc[s:s + m])).values())
                best = max(best, both / (len(own) + m - both)) if m else best
            if best >= least:
                out[doc_id, item] = max(best, out.get((doc_id, item), 0))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(14, 59)))) for i in range(n)]


def planted(items, seed, n=150):
    rng, rows = random.Random(seed), []
    filler = lambda k: [rng.choice("klmnopqrst") * rng.randint(1, 4) for _ in range(k)]
    for i in range(n):
        words = filler(rng.randint(0, 80))
        if i % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                passage[rng.randrange(len(passage))] = "changed"
            cut = rng.choice([0, 0, 0, len(passage) // 2])
            words += passage[cut:] + filler(rng.randint(0, 30))
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words).upper() if i % 3 else " ".join(words)))
    return rows


def test_equals_all_windows(spark):
    items = passages(1, 40)
    rows = planted(items, 2)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, m.item_id): m.similarity for r in d.find_benchmark(frame, bench).collect() for m in r.matches}
    expected = plain(rows, items)
    assert len(expected) > 30
    assert got == pytest.approx(expected)


def test_blocks_of_items_and_short_items(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEMS", 7)
    items = passages(3, 20) + [(90, "two words"), (91, None), (92, ""), (None, "a b c d e f g"), (93, "abc"), (5, "Two, words!")]
    rows = planted(items[:20], 4, 40) + [(200, "here are two words of it"), (201, None), (202, ""), (203, "ABC")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, m.item_id): m.similarity for r in d.find_benchmark(frame, bench).collect() for m in r.matches}
    assert got == pytest.approx(plain(rows, items))
    kept = d.drop_contaminated(frame, bench)
    assert kept.columns == ["doc_id", "text"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got}


@pytest.mark.parametrize("radius", [3, 12, 20])
def test_index_returns_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 2**64, 50, dtype=np.uint64)
    flips = np.zeros(400, np.uint64)
    for _ in range(radius + 2):
        flips |= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    asked = prints[rng.integers(0, 50, 400)] ^ flips
    got = set(zip(*(x.tolist() for x in d.BlockIndex(prints, radius).within(asked))))
    near = np.bitwise_count(asked[:, None] ^ prints[None, :]) <= radius
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)))) and got


def test_index_selects_and_meets_changed_passages():
    """Few of all pairs are candidates; windows of similarity 0.8 or more are within the radius."""
    rng = np.random.default_rng(8)
    prints, asked = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (300, 2000))
    assert len(d.BlockIndex(prints, d.RADIUS).candidates(asked)[0]) < 0.05 * 300 * 2000

    items, rnd, near, far = passages(9, 60), random.Random(10), 0, 0
    known = d.Items(items, 5, d.RADIUS)
    for _ in range(1500):
        i = rnd.randrange(60)
        words = items[i][1].split()
        for _ in range(rnd.randint(1, 2)):
            words[rnd.randrange(len(words))] = "changed"
        shingle = d.words_of(*buffers(pa.array([" ".join(words)]))).windows(5)[1]
        if d.similarity(shingle, known.bags[i]) >= 0.8:
            own, index = known.groups[len(words)]
            of = d._packed((2 * d.simhash(shingle).sum(0, dtype=np.int64) > len(shingle))[None])
            near += i in own[index.within(of)[1]]
            far += i not in own[index.within(of)[1]]
    assert near + far > 100 and near >= 0.95 * (near + far)


def test_edge_rows(spark, edge, edge_rows):
    bench = spark.createDataFrame(passages(5, 3) + [(7, edge_rows[5][1])], "item_id long, text string")
    got = {(r.doc_id, m.item_id) for r in d.find_benchmark(edge, bench).collect() for m in r.matches}
    short = [(i, t) for i, t in edge_rows if i not in (4, 5)]
    assert got == set(plain(short, [(7, edge_rows[5][1])])) and got
    assert d.drop_contaminated(edge, bench).columns == edge.columns
    assert d.find_benchmark(edge.limit(0), bench).count() == 0
    assert all(r.matches == [] for r in d.find_benchmark(edge, bench.limit(0)).collect())


def test_query_finds_the_passages_in_the_tables(spark):
    from shellsieve.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    verbatim = {doc for doc, text in rows for _, passage in items if passage in (text or "")}
    found = {r.doc_id for r in QUERIES["op5_simhash_windows"](spark, folder).collect()}
    assert verbatim and verbatim <= found
    assert len(found - verbatim) <= 2
