"""Every registered query against its SQL on DuckDB, by sorted rows."""

import math

import duckdb
import pytest

from larkspur import queries

SF = "/root/testdata/sf0.001"
TABLES = queries.TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else repr(x)

    return [names[i] for i in order], sorted([cell(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = norm(df.columns, [tuple(r) for r in df.collect()])
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    rel = duck.execute(sql)
    want = norm([c[0] for c in rel.description], rel.fetchall())
    assert got == want
