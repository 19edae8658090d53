import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shellsieve.llm.naming import exact_duplicates, identities

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def plain(rows):
    """Groups by the normalised text itself."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def found(frame, **options):
    return sorted(map(tuple, exact_duplicates(frame, **options).select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def blocky():
    """Texts of few blocks in many orders, so that blocks, pairs and beginnings repeat."""
    rng = random.Random(5)
    pool = ["abcd", "abce", "ÄÖ", "zz  ", "abc\t", "dcba"]
    return [(i, "".join(rng.choice(pool[:3 + i % 4]) for _ in range(rng.randint(0, 9)))) for i in range(400)]


@pytest.mark.parametrize("size", [3, 4096])
def test_equals_grouping_by_text(spark, blocky, size):
    assert found(spark.createDataFrame(blocky, "doc_id long, text string"), size=size) == plain(blocky)


def test_clashing_keys_are_told_apart_by_content(spark, blocky):
    """Five keys for all blocks: the result is that of the contents."""
    frame = spark.createDataFrame(blocky, "doc_id long, text string")
    assert found(frame, size=12, key=lambda b: F.pmod(F.xxhash64(b), F.lit(5))) == plain(blocky)


def test_name_is_one_per_text(spark, blocky):
    rows = identities(spark.createDataFrame(blocky, "doc_id long, text string"), size=16).collect()
    assert len({r.row for r in rows}) == len(blocky)
    assert len({(r.rounds, r.name) for r in rows}) == len({r.text_sha256 for r in rows}) > 50


def test_edge_rows(edge, edge_rows):
    assert found(edge) == plain(edge_rows)
    assert exact_duplicates(edge.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, documents):
    plan = exact_duplicates(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
