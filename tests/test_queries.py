"""Every query against its SQL counterpart on the smallest tables."""

import oracle_check
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle_check.connect(small)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_matches_sql(spark, small, con, name):
    assert oracle_check.compare(QUERIES[name](spark, small), con, ORACLE[name]) == []


def test_every_counterpart_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 2
