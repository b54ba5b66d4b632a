"""Sketched and exact window counts against sets in plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from evimine.llm import distinct, queries

SCHEMA = "id long, kind string, day int"


def brute(rows, days=7, gap=1):
    used = {r for r in rows if None not in r}
    kinds = sorted({k for _, k, _ in used})
    within = lambda k, end: {i for i, kind, d in used if kind == k and end - days < d <= end}
    out = {}
    for day in {d for _, _, d in used}:
        for a in kinds:
            for b in kinds:
                x, y = within(a, day), within(b, day - gap)
                out[day, a, b] = len(x | y), len(x & y), len(x - y)
    return out


def rows(n, ids, seed):
    r = random.Random(seed)
    some = [(1 if r.random() < 0.3 else r.randrange(ids), r.choice("aaabbc"), r.choice((1, 2, 3, 4, 9, 10, 20, 40, 41))) for _ in range(n)]
    return some + some[:50] + [(None, "a", 1), (3, None, 2), (3, "a", None), (7, "zzz", 100)]


@pytest.mark.parametrize(("n", "ids"), [(300, 40), (9000, 3000)])
def test_equals_sets(spark, n, ids):
    made = rows(n, ids, n)
    found = distinct.window_pairs(spark.createDataFrame(made, SCHEMA).withColumn("n_both", F.lit("clash")).repartition(3)).collect()
    expected = brute(made)
    assert {(r.day, r.kind_a, r.kind_b): (r.n_union, r.n_both, r.n_only_a) for r in found} == expected and len(found) == len(expected)
    held = 0
    for r in found:
        for name in ("union", "both", "only_a"):
            est, err, exact = r[f"est_{name}"], r[f"err_{name}"], r[f"n_{name}"]
            assert est >= 0 and 0 <= err <= 8 * r.est_union / 512**0.5 + 3
            held += abs(est - exact) <= err
    assert held >= 0.95 * 3 * len(found)
    if ids <= 200:  # nothing is left out of a sketch
        assert all(r.est_union == r.n_union and r.est_both == r.n_both and r.err_union == r.err_both == r.err_only_a == 0 for r in found)


def test_other_windows(spark):
    made = rows(500, 60, 5)
    found = distinct.window_pairs(spark.createDataFrame(made, SCHEMA), days=3, gap=2).collect()
    assert {(r.day, r.kind_a, r.kind_b): (r.n_union, r.n_both, r.n_only_a) for r in found} == brute(made, 3, 2)


def test_no_rows(spark):
    assert distinct.window_pairs(spark.createDataFrame([(None, "a", 1)], SCHEMA)).count() == 0


def test_sketches_stay_within_size(spark):
    """At most 512 hashes, whether sketched in one task or merged from many."""
    many = spark.range(0, 200_000, 1, 7).select(F.col("id"), F.lit("k").alias("kind"), (F.col("id") % 3).alias("day"))
    for one in (many, many.coalesce(1)):
        daily = distinct.daily_sketches(one)
        for sketches in (daily, distinct.window_sketches(daily, 7)):
            assert sketches.agg(F.max(F.length("sketch"))).first()[0] <= 8 * distinct.SIZE


def test_bound_is_the_root():
    from math import isclose, sqrt

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for n, theta in ((256, 0.1), (0, 0.01), (30, 0.5)):
        above = spark.range(1).select(distinct.bound(F.lit(n / theta), F.lit(theta))).first()[0] + n / theta
        assert isclose(above * theta - distinct.DEVIATIONS * sqrt(above * theta * (1 - theta)), n, abs_tol=1e-6)


def test_query_on_clicks(spark, tmp_path):
    at = lambda d, h: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    made = [(1, at(0, 23), 5, "view"), (2, at(1, 0), 5, "buy"), (3, at(9, 1), 6, "view"), (4, None, 6, "view"), (5, at(2, 2), None, "buy")]
    spark.createDataFrame(made, "click_id long, ts timestamp_ntz, client_id long, kind string").write.parquet(f"{tmp_path}/clicks.parquet")
    found = queries.op13_theta_windows(spark, str(tmp_path)).collect()
    epoch = datetime.date(2024, 1, 1).toordinal() - datetime.date(1970, 1, 1).toordinal()
    assert len(found) == 3 * 4 and {r.day - epoch for r in found} == {0, 1, 9}
    assert next(r for r in found if r.day == epoch + 1 and (r.kind_a, r.kind_b) == ("buy", "view")).n_both == 1
