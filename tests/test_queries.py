"""Every registered core query against its SQL on the smallest tables."""

import pytest

import oracle
from corvane import oracle as sql
from corvane import queries


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in sql.SQL])
def test_same_rows_as_sql(spark, name):
    ours, theirs = oracle.compare(spark, name)
    assert not ours and not theirs, (name, list(ours)[:3], list(theirs)[:3])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in sql.SQL])
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, f"{oracle.ROOT}/sf0.001").count() > 0


def test_every_sql_has_a_query():
    assert set(sql.SQL) <= set(queries.QUERIES)
