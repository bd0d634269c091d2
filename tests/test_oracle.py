"""Every query with a SQL counterpart returns exactly its rows, with the same types."""

import pytest
from compare import connect, difference, spark_rows, sql_rows

from __spark_entry__ import entry, oracle_sql, queries

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, small, con, name):
    df = queries()[name](spark, small)
    wanted = sql_rows(con, oracle_sql()[name])
    assert difference(spark_rows(df), wanted) is None
    described = {r[0]: r[1] for r in con.execute("DESCRIBE " + oracle_sql()[name]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == described


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len([q for q in queries() if not q.startswith("op") and q != "pipeline"]) == 110


def test_entry_answers(spark):
    df = entry(spark)
    assert "is_extremist_content" in df.columns
    assert df.count() == 200
