"""Every named query with SQL gives DuckDB's rows at the smallest scale; the others run."""

import os

import pytest

from tabloom.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v.tolist() if hasattr(v, "tolist") else v


def same_rows(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([plain(v) for v in r]) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert mine == theirs


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        same_rows(df, duck.sql(queries.ORACLE_SQL[name]))
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
