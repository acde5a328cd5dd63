"""Every registered query equals its DuckDB oracle on the sf0.001 tables,
and the smoke entry returns rows."""

import os

import duckdb
import pytest

from conftest import SF001
import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF001, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(rows):
    def v(x):
        return round(x, 6) if isinstance(x, float) else x
    return sorted(tuple("NULL" if x is None else str(v(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert rows is not None
        return
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    orows = cur.fetchall()
    order = [ocols.index(c) for c in df.columns]
    assert _norm(rows) == _norm([tuple(r[i] for i in order) for r in orows])


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
