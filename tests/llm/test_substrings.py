import random
import re

import pytest

from shellsieve.llm.substrings import remove_repeats


def plain(rows, size):
    """By listing every window of every document."""
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    order = lambda d: 2**63 if d is None else d
    places = {}
    for n, (d, words) in enumerate(docs):
        for k in range(len(words) - size + 1):
            places.setdefault(tuple(words[k:k + size]), []).append((order(d), n, k))
    out = []
    for n, (d, words) in enumerate(docs):
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            here = places[tuple(words[k:k + size])]
            if min(here)[0] < order(d) or any(m == n and x < k for _, m, x in here):
                gone[k:k + size] = [True] * size
        out.append((d, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [2, 7, 20])
def test_equals_listing_of_windows(spark, size):
    rng = random.Random(size)
    word = lambda letters: rng.choice(letters) * rng.randint(1, 3)
    shared = [" ".join(word("abcdefghij") for _ in range(rng.randint(size - 1, 3 * size))) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(word("klmnopq") for _ in range(rng.randint(1, 40)))
                 for _ in range(rng.randint(0, 5))]
        rows.append((i * 7 % 81, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [rows[3], (5, "a b c " * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, remove_repeats(frame, size).collect()), key=repr)
    assert got == plain(rows, size)
    assert sum(r[2] for r in got)


def test_edge_rows(edge, edge_rows):
    got = sorted(map(tuple, remove_repeats(edge, 20).collect()), key=repr)
    short = [(d, t if t is None or len(t) < 10_000 else None) for d, t in edge_rows]
    expected = {r[:3] for r in plain(short, 20)}
    assert {r[:3] for r in got if r[0] not in (4, 5)} == {r for r in expected if r[0] not in (4, 5)}
    by_id = {r[0]: r for r in got}
    assert by_id[5][1] == by_id[5][2] == 60_000 and by_id[5][3] == ""
    assert by_id[4][2] == 0  # w997x89 repeats after 88,733 words only
    assert remove_repeats(edge.limit(0)).count() == 0


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    """1,024 letters in the order of digit sums and its complement: equal modulo 2**64 under every base."""
    sums = [i.bit_count() % 2 for i in range(1024)]
    one, other = ("".join(letters[s] for s in sums) for letters in ("ab", "ba"))
    rows = [(1, " ".join([*["w"] * 19, one])), (2, " ".join([*["w"] * 19, other])), (3, " ".join([*["w"] * 19, one]))]
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=20).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
