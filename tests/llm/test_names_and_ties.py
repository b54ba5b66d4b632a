"""Columns that are named like an operator's own, sources of equal ids, and vectors at the ends of what a double holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evimine.llm import ann, mixing, ngram_join, queries, substrings

OWN = ["_id", "_k", "_places", "_key", "_source", "_whole", "_cut", "_place", "_slice", "_words", "_copy", "row", "id", "words", "place", "slice", "own", "own_text", "n", "copy", "at", "upto", "digest", "_range", "left", "extra", "whole", "cut", "doc"]
TEXT = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, TEXT, "a", 60), (2, TEXT, "a", 60), (3, f"{TEXT} more", "b", 61), (None, TEXT, None, 60), (4, None, "b", 0), (5, "short", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long").select("*", *(F.lit(n).alias(n) for n in OWN))


def test_one_of_each_keeps_any_column(odd):
    found = ngram_join.one_of_each(odd)
    assert found.columns == odd.columns and {(r.doc_id, r._id) for r in found.collect()} == {(1, "_id"), (None, "_id"), (4, "_id"), (5, "_id")}


@pytest.mark.parametrize("spaced", [False, True])
def test_dedup_keeps_any_column(odd, spaced):
    found = substrings.dedup(odd, spaced=spaced)
    assert found.columns == [*odd.columns, "n_words", "n_removed", "kept"]
    assert {(r.doc_id, r.n_words, r.n_removed, r._k, r._places) for r in found.collect()} == {(1, 60, 0, "_k", "_places"), (2, 60, 60, "_k", "_places"), (3, 61, 60, "_k", "_places"), (None, 60, 0, "_k", "_places"), (4, 0, 0, "_k", "_places"), (5, 1, 0, "_k", "_places")}


def test_mix_and_expand_keep_any_column(odd):
    found = mixing.mix(odd)
    assert found.columns == [*odd.columns, "source_size", "target", "repeats"]
    rows = found.collect()
    assert len(rows) == 6 and all(r[n] == n for r in rows for n in OWN)
    more = mixing.expand(found, odd.columns)
    assert more.columns == odd.columns and more.count() == sum(r.repeats for r in rows)


@pytest.mark.parametrize("ids", [[None] * 3000, [7] * 3000, [7] * 2990 + list(range(10))])
def test_sources_of_equal_ids_meet_their_target(spark, ids):
    rows = [(i, "hot", 1 + n % 7) for n, i in enumerate(ids)] + [(10_000 + n, f"s{n % 3}", 40) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.repeats <= 3 for r in found)
    for source in ("hot", "s0", "s1", "s2"):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.size * r.repeats for r in own) - own[0].target) <= max(r.size for r in own)
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_query_on_equal_rows_equals_sql(spark, tmp_path):
    from test_sql import compare

    rows = [(None if n % 3 else 5, f"a b {'c ' * (n % 4)}", "en", "hot" if n % 10 else None, 1) for n in range(900)] + [(n, "x " * (n % 30), "en", f"s{n % 4}", 1) for n in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, "op7_source_mix", str(tmp_path), ["documents"])
    found = queries.op7_source_mix(spark, str(tmp_path)).where("source_size > 1000").agg(F.sum("taken"), F.max("target")).first()
    assert abs(found[0] - found[1]) <= 5


@pytest.mark.parametrize("factor", [1e300, 1e160, 1e-170, 1e-320])
def test_vectors_of_any_length(spark, factor):
    r = np.random.default_rng(1)
    plain = r.standard_normal((300, 8)) * (1 if factor > 1e-300 else 100)
    made = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = {(x.query_id, x["rank"]): x for x in ann.search(made(plain), lambda i: i % 50 == 0).collect()}
    got = {(x.query_id, x["rank"]): x for x in ann.search(made(plain * factor if factor > 1e-300 else plain), lambda i: i % 50 == 0).collect()}
    assert len(want) == 30 and all(got[k].vec_id == x.vec_id and np.isclose(got[k].score, x.score) for k, x in want.items())
