"""Every registered query against its SQL, or by its schema where it has none."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from shellsieve.checks.oracle import ORACLE
from shellsieve.checks.queries import QUERIES


SAME_TYPE = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert ORACLE.items() <= entry.oracle_sql().items()
    assert set(QUERIES) - set(ORACLE) == {
        "rf_scores", "rf_importance", "rf_grid", "rf_search",
    }


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(names)
    types = {column[0]: str(column[1]) for column in result.description}
    assert {name: SAME_TYPE[kind] for name, kind in frame.dtypes} == types
    actual, expected = _rows(frame.columns, frame.collect()), _rows(names, result.fetchall())
    missing, surplus = expected - actual, actual - expected
    assert not missing and not surplus, (
        f"{sum(missing.values())} rows missing, {sum(surplus.values())} too many; e.g. "
        f"{list(missing)[:2]} vs {list(surplus)[:2]}"
    )
    assert actual


ORDERED = {
    "findings_sorted": "score DESC, cmd_id",
    "findings_table": "CAST(replace(score, '%', '') AS DOUBLE) DESC, cmd_id",
    "findings_by_date": "shown ASC NULLS FIRST, cmd_id",
    "findings_by_source": "lower(source), cmd_id",
    "findings_top": "score DESC, cmd_id",
}


@pytest.mark.parametrize("name", ORDERED)
def test_findings_come_in_order(spark, duck, sf_dir, name):
    """Bags do not tell an unsorted result from a sorted one: compare as lists."""
    frame = QUERIES[name](spark, sf_dir)
    result = duck.execute(f"SELECT * FROM ({ORACLE[name]}) ORDER BY {ORDERED[name]}")
    names = [c[0] for c in result.description]
    assert [tuple(r[c] for c in names) for r in frame.collect()] == result.fetchall()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
