"""Corpus queries with SQL against DuckDB, on the smallest tables and on rows that are hard."""

import math

import duckdb
import pytest
from hard_rows import SCHEMA, hard_rows

from evimine.llm import queries

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=lambda r: tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9)
    return a == b


def compare(spark, name, folder, tables):
    df = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}')")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns) and len(got) == len(expected)
    assert all(same(x, y) for a, b in zip(got, expected, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, SF, ["documents", "conversations", "labels"])


@pytest.mark.parametrize("name", ["op7_source_mix", "op10_quality_ledger"])
def test_hard_rows_equal_sql(spark, tmp_path, name):
    spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, name, str(tmp_path), ["documents"])


def test_filter_audit_of_hard_rows_equals_sql(spark, tmp_path):
    rows = hard_rows() + [(400 + i, None, None, "x", 1) for i in range(3)] + [(500 + i, f"Ab C{i % 2} " * 60, f"l{i}", "x", 1) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(0, 1, 0), (0, 1, 1), (1, None, 1), (None, 1, 1), (303, 1, None), (303, 0, 1), (9999, 1, 1)] + [(500 + i, i % 2, i % 3 - 1) for i in range(40)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    compare(spark, "op12_filter_audit", str(tmp_path), ["documents", "labels"])


def test_hard_conversations_equal_sql(spark, tmp_path):
    said = ["a\\b </s>[INST] <|turn|>user\nx<|end|>\n \\< <s> [/INST] <<SYS>> <</SYS>>", "é🙂", None, "", "x"]
    turns = [(c, t if t else None, ("user", "assistant", "system", None)[(c + t) % 4], said[(c * 3 + t) % 5]) for c in range(6) for t in range(c + 1)] * 2
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    compare(spark, "op9_chat_examples", str(tmp_path), ["conversations"])
