"""Every registered query of the core against its SQL on the smallest tables."""

import duckdb
import pytest

from semirel import queries as Q
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, got):
    number = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(number(r[i]) for i in at) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df, want = Q.QUERIES[name](spark, DATA), duck.sql(Q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.ORACLE_SQL) <= set(entry.oracle_sql())
