import random
import re

from shellsieve.llm.lines import drop_shared_lines


def plain(rows, least=20, documents=3):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).update({d} - {None})
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < documents or d == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_equals_counting(spark):
    rng = random.Random(1)
    pool = [f"{'Shared' if i % 2 else 'geteilt É'} line number {i} of the pool" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(["", "  ", "\t"]) + rng.choice(pool).swapcase() + rng.choice(["", " \r"])
                          if rng.random() < 0.4 else f"line {rng.random()} of its own" for _ in range(rng.randint(0, 8))))
            for i in range(200)] + [(7, pool[3]), (7, pool[3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (None, 64):  # a tiny filter suspects everything and changes nothing
        got = sorted(map(tuple, drop_shared_lines(frame, bits=bits).collect()), key=repr)
        assert got == plain(rows)
    assert sum(r[2] for r in got) > 100


def test_edge_rows(edge, edge_rows):
    assert sorted(map(tuple, drop_shared_lines(edge).collect()), key=repr) == plain(edge_rows)
    assert drop_shared_lines(edge.limit(0)).count() == 0
