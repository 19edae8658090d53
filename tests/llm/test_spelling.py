import random
import re
import zlib
from collections import Counter

import pytest

from shellsieve.llm import spelling
from shellsieve.llm.spelling import spelling_variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(rows, every=199, least=5):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def found(frame, **options):
    return sorted(map(tuple, spelling_variants(frame, **options).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("parts", [3, 9])
def test_equals_all_pairs(spark, parts):
    """Words with repeated letters, anagrams, accents, chains of forms; every second run loses a letter."""
    rng = random.Random(4)
    base = ["banana", "bananas", "canana", "nabana", "ÉCOLES", "écoles", "strasse", "STRASSEN", "mississippi", "aaaaaa", "aaaaaaa"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(2 + 900 // (i + 1)))) for i in range(120)]
    want = plain(rows, every=2)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), every=2, parts=parts) == want
    assert max(r[4] for r in want) > 5


def test_forms_are_followed_to_the_last(spark):
    rows = [(1, "plante " * 5 + "planter " * 30 + "planters " * 160), (2, "planterz " * 6)]
    want = plain(rows, every=10**9)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), every=10**9) == want
    assert {r[0]: r[2] for r in want}["plante"] == "planters"


def test_edge_rows(edge, edge_rows):
    assert found(edge, least=1) == plain(edge_rows, least=1)
    assert spelling_variants(edge.limit(0)).count() == 0


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """A table of few bytes, which Spark would send to all tasks, may have many signatures."""
    plans = []

    def noted(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    monkeypatch.setattr(spelling, "written", lambda frame, real=spelling.written: real(noted(frame)))
    rows = [(1, "plante " * 5 + "planter " * 30 + "planters " * 160)]
    noted(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum("SortMergeJoin" in p for p in plans) >= 5
    assert not any("Broadcast" in p for p in plans)
