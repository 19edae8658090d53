"""Every operator is registered; those that SQL expresses equal their SQL."""

import pytest

import __spark_entry__ as entry
from shellsieve.llm.oracle import ORACLE
from shellsieve.llm.queries import QUERIES


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    expected = sorted(map(tuple, result.fetchall()), key=repr)
    assert sorted(map(tuple, frame.select(*names).collect()), key=repr) == expected
    assert expected
