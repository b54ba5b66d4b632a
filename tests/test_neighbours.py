"""Nearest-neighbour information against all pairs of rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evimine.functions import stats
from evimine.operators import neighbours


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute(rows, k):
    rows = [(v, y) for v, y in rows if v is not None and y is not None and v == v]
    rows = [(v, y) for v, y in rows if sum(z == y for _, z in rows) > 1]
    if not rows:
        return None
    total = 0.0
    for i, (v, y) in enumerate(rows):
        same = sorted(abs(u - v) for j, (u, z) in enumerate(rows) if z == y and j != i)
        kk = min(k, len(same))
        r = same[kk - 1]
        m = sum(v - r < u < v + r for u, _ in rows) if r > 0 else sum(u == v for u, _ in rows)
        total += psi(kk) - psi(len(same) + 1) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


def test_digamma(spark):
    found = spark.range(1, 3000).select("id", stats.digamma(F.col("id").cast("double")).alias("psi")).collect()
    assert all(math.isclose(r.psi, psi(r.id), abs_tol=1e-12) for r in found[:300]) and math.isclose(found[-1].psi, psi(2999), abs_tol=1e-11)


@pytest.mark.parametrize(("block", "ranges"), [(4096, 1), (10, 16)])
def test_equals_all_pairs(spark, block, ranges):
    r = random.Random(1)
    label = [r.choice((0, 0, 1)) for _ in range(2000)]
    features = {
        "apart": [r.gauss(3.0 * y, 1) for y in label], "alike": [r.random() for _ in label], "few": [float(r.choice((1, 1, 2, 5 + y))) for y in label], "round": [round(r.gauss(y, 1), 2) for y in label],
        "holes": [None if r.random() < 0.3 else float(r.randint(0, 50)) for _ in label], "nan": [float("nan") if r.random() < 0.1 else r.random() + y for y in label], "one": [4.0] * 2000,
    }
    odd = [("small", 1.0, 0), ("small", 2.0, 0), ("small", 9.0, 1), ("small", 1.5, None), ("alone", 1.0, 0), ("alone", 2.0, 1), ("pair", 1.0, 0), ("pair", 1.0, 0)]
    rows = [(f, v, y) for f, vs in features.items() for v, y in zip(vs, label, strict=True)] + odd
    made = spark.createDataFrame(rows, "feature string, value double, label int").repartition(4)
    found = {x.feature: x.information for x in neighbours.mutual_information(made, 3, block, ranges).collect()}
    want = {f: brute([(v, y) for g, v, y in rows if g == f], 3) for f in {x[0] for x in rows}}
    assert found.keys() == {f for f, x in want.items() if x is not None}
    assert all(math.isclose(found[f], want[f], abs_tol=1e-9) for f in found)
    assert found["apart"] > 0.3 and found["alike"] < 0.05 and neighbours.mutual_information(made.where("false")).count() == 0
