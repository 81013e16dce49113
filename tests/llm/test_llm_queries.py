"""The problems' queries on the smallest tables; those with SQL against it."""

import pytest
from oracle import connect, rows, sql_rows

from auditloom.llm import queries as module

QUERIES, SQL = module.queries(), module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert rows(df) == sql_rows(con, SQL[name])
    else:
        assert df.count() >= 0


def test_every_problem_has_queries():
    assert {int(n[1:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
