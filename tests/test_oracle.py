"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from evimine.plans import check_queries, detail_queries, rule_queries, scale_queries, study_queries, table_queries, wide_queries

SF = "/root/testdata/sf0.001"
SQL = {**table_queries.ORACLE_SQL, **rule_queries.ORACLE_SQL, **study_queries.ORACLE_SQL, **check_queries.ORACLE_SQL, **detail_queries.ORACLE_SQL, **wide_queries.ORACLE_SQL, **scale_queries.ORACLE_SQL}
QUERIES = {**table_queries.QUERIES, **rule_queries.QUERIES, **study_queries.QUERIES, **check_queries.QUERIES, **detail_queries.QUERIES, **wide_queries.QUERIES, **scale_queries.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=lambda r: tuple(str(x) if not isinstance(x, float) else f"{x:.4f}" for x in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    expected = rows(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns) and len(got) == len(expected)
    assert all(same(x, y) for a, b in zip(got, expected, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
