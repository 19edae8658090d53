import random
import re

import numpy as np
import pytest
import xxhash

from shellsieve.llm import simhash


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """Smallest id reachable, by comparing all pairs; None counts as no id."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, f) in enumerate(prints):
        for j in range(i):
            if (f ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f, least.get(find(i))) for i, (d, f) in enumerate(prints)]


def varied(seed, n):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(80, 300))] for _ in range(6)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words) if i % 9 else " ".join(rng.choice("klmnop") for _ in range(i))))
    return out


def test_equals_all_pairs(spark):
    rows = varied(3, 150)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    expected = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert got == set(expected)
    assert len({c for *_, c in expected}) < len(rows)


def test_edge_rows(edge, edge_rows):
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(edge).collect()), key=repr)
    expected = plain_components([(d, plain_fingerprint(t)) for d, t in edge_rows])
    assert got == sorted(expected, key=repr)
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def test_keep_one(spark, edge, edge_rows):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    classes = {c for _, _, c in plain_components([(d, plain_fingerprint(t)) for d, t in edge_rows])}
    assert sorted(ids, key=repr) == sorted(classes, key=repr)
    lone = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert simhash.keep_one(lone).count() == 1


@pytest.mark.parametrize("radius", [1, 4])
def test_links_connect_what_is_near(radius):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**64, 5, dtype=np.uint64)
    f = np.unique(np.concatenate([
        c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (120, 6)).astype(np.uint64), axis=1) for c in centre]))
    for key in (np.zeros(len(f), np.int64), np.arange(len(f)) // 7):
        links = simhash.pivot_links(f, key, radius)
        assert (np.bitwise_count(f[links[0]] ^ f[links[1]]) <= radius).all()
        labels = np.arange(len(f))
        for _ in range(len(f)):
            before = labels.copy()
            for a, b in links.T:
                labels[a] = labels[b] = min(labels[a], labels[b])
            if (labels == before).all():
                break
        for i in range(len(f)):
            near = (np.bitwise_count(f ^ f[i]) <= radius) & (key == key[i])
            assert (labels[near] == labels[i]).all()


@pytest.mark.parametrize("n", [10, 10**8, 10**11])
def test_some_choice_of_blocks_agrees(n):
    masks, rng = simhash.block_choices(n, 4), random.Random(n)
    for _ in range(200):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)
