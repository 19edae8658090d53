import math

import numpy as np
import pytest

from shellsieve.llm import topk


def plain(rows, k, every, scale):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 1024), (37, 5)])
def test_equals_all_scores(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", sizes[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", sizes[1])
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=16) * 0.2]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (301, rows[0][1]), (302, None), (303, [1.0, None]),
             (304, [math.nan] * 16), (305, [math.inf] * 16), (340, [1.0, 2.0]), (341, [3.0, 1.0]), (None, rows[1][1]), (360, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(map(tuple, topk.top_k(frame).collect()))
    assert got == plain(rows, 20, 20, 64)
    assert topk.top_k(frame.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [10, 10**4, 10**8])
def test_bounds_hold_and_result_is_exact(scale):
    rng = np.random.default_rng(scale)
    x, q = (np.floor(rng.normal(size=(n, 12)) * scale).astype(np.int64) for n in (500, 30))
    exact = q @ x.T
    lists = topk.Lists(x)
    reading = topk.Reading(lists, q, np.ones((500, 30), bool))
    for depth in (1, 100, 250, 499, 500):
        reading.read(depth)
        lower, upper = reading.bounds()
        assert (lower <= exact.T).all() and (exact.T <= upper).all()
    assert (lower == upper).all()
    rows, columns, score, entries = topk.aggregate(np.arange(500), x, np.arange(1000, 1030), q, 7)
    assert (exact[rows, columns] == score).all()
    assert (entries <= 500 * 12).all()
    for i in range(30):
        assert sorted(zip(-score[rows == i], columns[rows == i])) == sorted(zip(-exact[i], range(500)))[:7]


def test_unread_entries_are_not_used():
    """Entries beyond the depth may hold anything that keeps the lists' order."""
    rng = np.random.default_rng(4)
    x, q = rng.integers(-50, 50, (200, 8)), np.abs(rng.integers(-50, 50, (9, 8)))
    bounds = []
    for change in (False, True):
        own = x.copy()
        if change:
            for j in range(8):
                hidden = np.argsort(x[:, j], kind="stable")[1:120]
                own[hidden, j] = x[:, j].min()
        reading = topk.Reading(topk.Lists(own), q, np.ones((200, 9), bool))
        reading.read(80)
        bounds.append(reading.known.copy())
    assert (bounds[0] == bounds[1]).all()


def test_leading_vectors_end_the_reading_early():
    rng = np.random.default_rng(5)
    x = rng.integers(-8, 8, (4000, 16))
    x[:7] = 60
    rows, columns, _, entries = topk.aggregate(np.arange(4000), x, np.array([-1]), np.full((1, 16), 5), 7)
    assert set(columns) == set(range(7))
    assert entries[0] < 0.6 * 4000 * 16
