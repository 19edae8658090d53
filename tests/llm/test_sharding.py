from collections import Counter
from itertools import combinations

import numpy as np

from shellsieve.llm import sharding


def shards_of(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.shard, []).append(r.slot)
    return out


def test_sizes_are_exact_and_slots_gapless(spark):
    frame = spark.range(1003).withColumnRenamed("id", "doc_id")
    dealt = sharding.shuffle_into_shards(frame, 40)
    parts = shards_of(dealt)
    assert sorted(parts) == list(range(40))
    assert sorted(map(len, parts.values())) == [25] * 37 + [26] * 3
    assert all(sorted(v) == list(range(len(v))) for v in parts.values())
    again = sharding.shuffle_into_shards(frame.repartition(7), 40)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, again.collect()))
    other = sharding.shuffle_into_shards(frame, 40, seed=18)
    assert sorted(map(tuple, dealt.collect())) != sorted(map(tuple, other.collect()))


def test_fewer_rows_than_shards_and_edge_rows(spark, edge, edge_rows):
    few = sharding.shuffle_into_shards(spark.range(3), 40)
    assert sorted(map(len, shards_of(few).values())) == [1, 1, 1]
    dealt = sharding.shuffle_into_shards(edge, 4)
    parts = shards_of(dealt)
    assert sorted(map(len, parts.values())) == [3, 3, 3, 4]
    assert all(sorted(v) == list(range(len(v))) for v in parts.values())
    got = Counter(map(tuple, dealt.select("doc_id", "text").collect()))
    assert got == Counter(edge_rows)
    assert sharding.shuffle_into_shards(edge.limit(0), 4).count() == 0


def test_a_third_of_equal_rows(spark):
    frame = spark.createDataFrame([(1, "same")] * 400 + [(i, "own") for i in range(800)], "doc_id long, text string")
    parts = shards_of(sharding.shuffle_into_shards(frame, 7))
    assert max(map(len, parts.values())) - min(map(len, parts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in parts.values())


def test_sources_follow_the_rows_and_equal_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 20)
    monkeypatch.setattr(sharding, "SOURCES", 4)
    monkeypatch.setattr(sharding, "SLICES", 2)
    seen, draw = [], sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda sizes, *rest: seen.append(sizes) or draw(sizes, *rest))
    rows = [(1, "same")] * 400 + [(i, "own") for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 _source", "6 __mark", "7 _before")
    dealt = sharding.shuffle_into_shards(frame, 7)
    assert dealt.columns == [*frame.columns, "shard", "slot"]
    assert len(seen[0]) == 60 and max(seen[0]) < 80
    assert Counter(tuple(r)[:2] for r in dealt.collect()) == Counter(rows)
    parts = shards_of(dealt)
    assert max(map(len, parts.values())) - min(map(len, parts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in parts.values())


def test_hypergeometric_law():
    from math import comb

    rng = np.random.Generator(np.random.PCG64(1))
    good, total, draws, n = 5, 12, 6, 40_000
    seen = Counter(sharding.hypergeometric(rng, good, total, draws) for _ in range(n))
    for k in range(6):
        p = comb(good, k) * comb(total - good, draws - k) / comb(total, draws)
        assert abs(seen[k] / n - p) < 0.01
    big = [sharding.hypergeometric(rng, 10**10, 4 * 10**11, 10**9) for _ in range(200)]
    assert abs(np.mean(big) - 2.5e7) < 5 * 5000 and 2000 < np.std(big) < 8000


def test_matrix_has_its_margins_and_is_uniform():
    matrix = sharding.communication_matrix([5, 0, 17, 9], [8, 8, 8, 7], 3)
    assert matrix.sum(1).tolist() == [5, 0, 17, 9] and matrix.sum(0).tolist() == [8, 8, 8, 7]
    counts = Counter(tuple(sharding.communication_matrix([2, 2], [2, 2], s).ravel()) for s in range(3000))
    # Of the 6 ways to choose which two rows go to the first shard, 1, 4 and 1 give these counts.
    assert len(list(combinations(range(4), 2))) == 6
    assert abs(counts[1, 1, 1, 1] / 3000 - 4 / 6) < 0.05 and abs(counts[2, 0, 0, 2] / 3000 - 1 / 6) < 0.05


def test_pairs_meet_as_often_as_in_a_uniform_shuffle(spark):
    frame = spark.range(12)
    together = Counter()
    for seed in range(40):
        by = {r.id: r.shard for r in sharding.shuffle_into_shards(frame, 3, seed=seed, sources=4).collect()}
        together.update((a, b) for a, b in combinations(range(12), 2) if by[a] == by[b])
    share = sum(together.values()) / (40 * 66)
    assert abs(share - 3 / 11) < 0.001  # exact sizes fix the total; pairs share it evenly:
    assert max(together.values()) < 40 * 0.7
