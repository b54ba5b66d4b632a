"""Quantiles, running sums and ranks that no single task holds, against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from evimine.functions import stats
from evimine.operators import quantiles, ranks


def long(spark, groups):
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, value double").repartition(5)


@pytest.mark.parametrize("few", [20_000, 40])
def test_quantiles_are_exact(spark, few):
    r = random.Random(2)
    groups = {
        "spread": [r.gauss(0, 1) for _ in range(3000)], "ties": [float(r.choice((1, 1, 1, 2, 7))) for _ in range(2000)], "wide": [10.0 ** r.uniform(-300, 300) * r.choice((-1, 1)) for _ in range(1500)],
        "one": [3.5], "two": [1.0, 2.0], "same": [4.0] * 900, "ends": [float("-inf"), 0.0, 1.0, float("inf")], None: [5.0, 6.0, 7.5], "tail": [1.0] * 1700 + [r.random() for _ in range(1300)],
    }
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    data = long(spark, groups).union(spark.createDataFrame([("spread", None), ("spread", float("nan")), ("none", None)], "g string, value double"))
    found = {(x.g, x.p): x.quantile for x in quantiles.quantiles(data, ["g"], probabilities, few=few).collect()}
    assert set(found) == {(g, p) for g in groups for p in probabilities}
    for (g, p), got in found.items():
        ordered = sorted(groups[g])
        at = p * (len(ordered) - 1)
        a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = a if a == b else a + (b - a) * (at - math.floor(at))
        assert got == want or math.isclose(got, want, rel_tol=1e-12) or (math.isnan(got) and math.isnan(want)), (g, p)


def test_quantiles_of_more_values_than_a_task_holds(spark):
    """Two million distinct values against a buffer of a thousand: three passes, and only a bracket's values are ever grouped."""
    n = 2_000_000
    values = spark.range(0, n, 1, 8).select(F.lit("x").alias("g"), (F.pmod(F.col("id") * 7_368_787, F.lit(n)) * 0.5).alias("value"))
    found = {x.p: x.quantile for x in quantiles.quantiles(values, ["g"], (0.25, 0.5, 0.9), few=1000).collect()}
    assert found == {p: 0.5 * p * (n - 1) for p in (0.25, 0.5, 0.9)}


def test_quantiles_survive_a_wrong_grid(spark, monkeypatch):
    """A grid that is off by far costs passes, not the result."""
    real, calls = quantiles._grid, []

    def off(value):
        calls.append(1)
        return F.transform(real(value), lambda x: x + 1000) if len(calls) == 1 else real(value)

    monkeypatch.setattr(quantiles, "_grid", off)
    values = [float(i) for i in range(5000)]
    found = quantiles.quantiles(long(spark, {"a": values}), ["g"], (0.5,), few=30).collect()
    assert [x.quantile for x in found] == [statistics.median(values)]


def test_quantiles_without_groups_or_rows(spark):
    data = spark.createDataFrame([(float(i),) for i in range(11)], "value double")
    assert [x.quantile for x in quantiles.quantiles(data, [], (0.5,)).collect()] == [5.0]
    assert quantiles.quantiles(data.where("false"), [], (0.5,)).count() == 0
    assert quantiles.medians(data, {"a": F.col("value"), "b": -F.col("value"), "none": F.lit(None)}) == {"a": 5.0, "b": -5.0}


def test_quantile_plan_has_no_product(spark):
    plan = quantiles._with(long(spark, {"a": [1.0]}).select("g", "value"), spark.createDataFrame([(("a",), 1.0)], "key struct<g:string>, high double"), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("n", [1, 64])
def test_running_equals_a_window(spark, n):
    r = random.Random(3)
    rows = [(r.choice(("a", "b", None)), r.randint(0, 400), r.randint(-5, 5)) for _ in range(1500)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "g string, k int, v long, id int")
    made = {"total": ("sum", "v"), "low": ("min", "v"), "high": ("max", F.col("v") * 2)}
    found = ranks.running(df, ["g"], [F.col("k").desc(), F.col("id").asc()], made, n)
    sums, want = {}, {}
    for g, k, v, i in sorted([(*x, i) for i, x in enumerate(rows)], key=lambda x: (str(x[0]), -x[1], x[3])):
        s, low, high = sums.get(g, (0, 99, -99))
        sums[g] = want[i] = (s + v, min(low, v), max(high, 2 * v))
    assert {x.id: (x.total, x.low, x.high) for x in found.collect()} == want
    whole = ranks.running(df, [], [F.col("id").asc()], {"total": ("sum", F.lit(1))}, n)
    assert all(x.total == x.id + 1 for x in whole.collect())


@pytest.mark.parametrize("n", [1, 64])
def test_metrics_equal_the_window(spark, n):
    r = random.Random(4)
    rows = [(r.choice("xy"), round(r.random(), 2), r.randint(0, 1)) for _ in range(3000)]
    counts = stats.score_counts(spark.createDataFrame(rows, "g string, score double, label int"), "score", "label", ("g",))
    got = {x.g: (x.auroc, x.average_precision) for x in ranks.ranking_metrics(counts, "score", ("g",), n).collect()}
    want = {x.g: (x.auroc, x.average_precision) for x in stats.ranking_metrics(counts, "score", ("g",)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], rtol=1e-12) for g in got)


def test_ranks_and_q_values(spark):
    r = random.Random(5)
    rows = [(i, "ab"[i % 2], None if i % 17 == 0 else round(r.random() ** 3, 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, p double")
    scaled = {x.id: x.q for x in ranks.step_up(df, "p", "q", ["g"], 9).collect()}
    small = {x.id: x.q for x in stats.benjamini_hochberg(df, "p", "q", ("g",)).collect()}
    assert len(scaled) == 600 and all((scaled[i] is None and small[i] is None) or math.isclose(scaled[i], small[i]) for i in small)
    for by in ([], ["g"]):
        for x in ranks.ranked(df, "p", by, 5).collect():
            same = [p for _, g, p in rows if p is not None and (not by or g == x.g)]
            rank = None if x.p is None else 1 + sum(p > x.p for p in same)
            assert x["rank"] == rank and (rank is None or math.isclose(x.points, (len(same) - rank + 1) / len(same)))
    assert ranks.step_up(df.where("false"), "p", "q").count() == 0


def test_no_window_without_ranges(spark):
    """Every window over rows is cut by ranges; only totals of ranges meet in one task."""
    df = spark.range(1000).select((F.col("id") % 7).alias("score"), F.col("id"))
    plan = ranks.running(df, [], [F.col("id").asc()], {"s": ("sum", F.lit(1))}, 8)._jdf.queryExecution().analyzed().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 2 and sum("_range" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows) == 2


def test_quantiles_of_two_heavy_values_end(spark, monkeypatch):
    """A median between two values that all rows share: the bracket holds them all for ever, and few values nevertheless."""
    calls, real = [], quantiles.stored
    monkeypatch.setattr(quantiles, "stored", lambda df: calls.append(1) or (real(df) if len(calls) < 9 else pytest.fail("no end")))
    values = spark.range(0, 40_000, 1, 4).select((F.col("id") % 2).cast("double").alias("value"))
    assert [x.quantile for x in quantiles.quantiles(values, [], (0.5,), few=100).collect()] == [0.5]


def test_quantiles_between_heavy_ends(spark, monkeypatch):
    """Thousands of distinct values between two that most rows share."""
    calls, real = [], quantiles.stored
    monkeypatch.setattr(quantiles, "stored", lambda df: calls.append(1) or (real(df) if len(calls) < 12 else pytest.fail("no end")))
    values = [0.0] * 60_000 + [1.0] * 60_000 + [i / 1001 for i in range(1, 1001)]
    found = {x.p: x.quantile for x in quantiles.quantiles(long(spark, {"a": values}), ["g"], (0.497, 0.5), few=30).collect()}
    ordered = sorted(values)
    want = lambda p: np.quantile(ordered, p)
    assert all(math.isclose(found[p], want(p), rel_tol=1e-12) for p in found)
