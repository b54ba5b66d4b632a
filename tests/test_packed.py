"""Models of all splits over packed rows against Spark ML's and plain computations, and what their passes cost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evimine.operators import packed, screening
from evimine.plans import facts as plans

FEATURES = ["f0", "f1", "f2", "f3"]


def labelled(spark, n=900, nulls=True, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(r.random() < 0.35)
        rows.append((i // 3, y, r.gauss(40 + 16 * y, 10), float(r.randrange(3)), None if nulls and r.random() < 0.1 else r.gauss(0.8 * y, 1), 7.0))
    return spark.createDataFrame(rows, "g long, y int, f0 double, f1 double, f2 double, f3 double").repartition(4)


@pytest.mark.parametrize("name", ["logistic", "lasso"])
def test_linear_models_are_those_of_spark(spark, name, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK", 100)
    monkeypatch.setattr(packed, "FIRST", 2)
    df = labelled(spark)
    trains = [F.col("g") % 3 != 0, F.col("g") % 3 != 1]
    r = packed.rows(df, FEATURES, "y", trains)
    found = packed.linear(r, [(0, (0, 1, 2, 3)), (1, (0, 1, 2, 3)), (1, (0, 2))], screening.LINEAR[name])
    for m, (train, features) in zip(found, ((trains[0], FEATURES), (trains[1], FEATURES), (trains[1], ["f0", "f2"])), strict=True):
        fitted = screening.fit(df.where(train), features, "y", name)
        own = m.coefficients()[[FEATURES.index(f) for f in features]]
        assert np.allclose(own, fitted.model.coefficients.toArray(), atol=2e-3)
        rows = fitted.score(df.where(~train), "y", FEATURES).toPandas()
        assert np.allclose(m(rows[FEATURES].to_numpy(float).T), rows["score"], atol=2e-3)


@pytest.mark.parametrize("held", [1 << 21, 100])
def test_held_out_metrics_are_exact(spark, held, monkeypatch):
    """Ranges of few scores, several records of each, tied scores."""
    for name, value in (("BLOCK", 128), ("RANGE", 60), ("HELD", held)):
        monkeypatch.setattr(packed, name, value)
    df = labelled(spark).withColumn("one", F.col("f1") * 0.25 + 0.3)
    r = packed.rows(df, [*FEATURES, "one"], "y", [F.col("g") % 2 == 0, F.lit(True)])
    got = packed.held_out(r, [lambda x: x[4], lambda x: 1 / (1 + np.exp(-(x[0] - 50) / 10)), lambda x: x[4]], [0, 0, 1])
    test = df.where("g % 2 = 1")
    for i, score in enumerate((F.col("one"), 1 / (1 + F.exp(-(F.col("f0") - 50) / 10)))):
        want = screening.metric_row(test.select(score.alias("score"), F.col("y").alias("label"))).first().asDict()
        assert got[i] == pytest.approx(want)
    assert got[2]["auroc"] is None and got[2]["recall"] == 0


def jobs(spark, work) -> int:
    spark.sparkContext.setJobGroup(name := f"packed-{random.random()}", "")
    work()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("", "")
    return found


def test_passes_do_not_grow_with_splits(spark):
    """Every split and fold was fitted by itself, in jobs of its own."""
    df = labelled(spark, nulls=False)
    few, many = (jobs(spark, lambda n=n: screening.repeated_holdouts(df, FEATURES, "y", "g", repeats=n)) for n in (2, 12))
    assert many <= few + 6 < 60
    few, many = (jobs(spark, lambda n=n: screening.permutation_importance(df, FEATURES, "y", "g", folds=n)) for n in (2, 6))
    assert many <= few + 6 < 60


def test_holdouts_equal_fits_of_their_own(spark, monkeypatch):
    df = labelled(spark)
    got = screening.repeated_holdouts(df, FEATURES, "y", "g", ("logistic", "lasso"), 2)
    monkeypatch.setattr(screening, "LINEAR", {})
    want = screening.repeated_holdouts(df, FEATURES, "y", "g", ("logistic", "lasso"), 2)
    assert [(r["model"], r["seed"]) for r in got] == [(r["model"], r["seed"]) for r in want]
    for a, b in zip(got, want, strict=True):
        assert {k: v for k, v in a.items() if k != "model"} == pytest.approx({k: v for k, v in b.items() if k != "model"}, abs=5e-3)


def test_importance_pairs_the_same_rows(spark, monkeypatch):
    """The partners are those of partnered, in one partition or several, and equal rows are one with its count."""
    monkeypatch.setattr(screening, "PAIRED", 120)
    df = labelled(spark).select("g", "y", F.round("f0", -1).alias("f0"), "f1", F.round("f2", 0).alias("f2"))
    features = ["f0", "f1", "f2"]
    got = screening.permutation_importance(df, features, "y", "g")
    assert screening.folded(df, features, "y", "g", 3).rows.count() < 600
    monkeypatch.setattr(screening, "LINEAR", {})
    want = screening.permutation_importance(df, features, "y", "g")
    assert got == pytest.approx(want, abs=2e-3) and got["f0"] > 0.05


def test_rows_that_are_all_alike(spark):
    df = spark.range(1000).select((F.col("id") % 9).alias("g"), F.lit(1.0).alias("a"), (F.col("id") % 2).cast("int").alias("y"), F.lit(None).cast("double").alias("b"))
    assert screening.permutation_importance(df, ["a", "b"], "y", "g") == {"a": 0.0, "b": 0.0}
    assert screening.stability(df, ["a", "b"], "y", "g", ("lasso",), 3) == {"a": 0.0, "b": 0.0}
    one = screening.repeated_holdouts(df.withColumn("y", F.lit(1)), ["a"], "y", "g", repeats=1)[0]
    assert one["auroc"] is None and one["recall"] == 1.0
    with pytest.raises(ValueError, match="no rows"):
        screening.repeated_holdouts(df.where("false"), ["a"], "y", "g", repeats=1)


def test_lines_are_those_of_facts(spark, tmp_path):
    """Keys that occur twice in a joined table double the lines; keys that are missing or null do not take them away."""
    for name in plans.TABLES:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "orders":
            df = df.where("o_orderkey % 7 <> 0").unionByName(df.where("o_orderkey % 5 = 1"))
        if name == "supplier":
            df = df.unionByName(df.limit(2)).unionByName(df.limit(2).withColumn("s_suppkey", F.lit(None).cast("long")))
        if name == "lineitem":
            df = df.withColumn("l_suppkey", F.when(F.col("l_linenumber") != 3, F.col("l_suppkey")))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for folder, more in (("/root/testdata/sf0.001", False), (str(tmp_path), True)):
        got, want = (f(spark, folder).groupBy("grp", "line", "l_partkey", "price", "y", "split").count() for f in (plans.lines, plans.facts))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        assert (got.agg(F.sum("count")).first()[0] > plans.read(spark, folder, "lineitem").count()) == more
        assert ("Join" in plans.lines(spark, folder)._jdf.queryExecution().executedPlan().toString()) == more


def test_boosted_trees_are_those_of_spark(spark, monkeypatch):
    """So few rows that both take their cuts from all of them. Two splits that part the training rows of a node alike may part others differently."""
    monkeypatch.setattr(packed, "BLOCK", 100)
    df = labelled(spark, 480)
    r = packed.rows(df, FEATURES, "y", [F.col("g") % 4 != 0])
    train, test = df.where("g % 4 <> 0"), df.where("g % 4 = 0")
    summed = packed.boosted(r, 0, [(0, 1, 2, 3), (2,)])
    monkeypatch.setattr(packed, "CELLS", 100)
    for m, by_cells, features in zip(packed.boosted(r, 0, [(0, 1, 2, 3), (2,)]), summed, (FEATURES, ["f2"]), strict=True):
        fitted = screening.fit(train, features, "y", "boosted")
        for side in (train, test):
            rows = fitted.score(side, "y", FEATURES).toPandas()
            near = np.isclose(m(rows[FEATURES].to_numpy(float).T), rows["score"], atol=1e-6)
            assert near.all() if side is train else near.mean() > 0.9
            same = np.isclose(m(rows[FEATURES].to_numpy(float).T), by_cells(rows[FEATURES].to_numpy(float).T))
            assert same.all() if side is train else same.mean() > 0.9


def test_thresholds():
    assert packed.thresholds(np.array([3.0]), np.ones(1)).tolist() == [] and packed.thresholds(np.array([1.0, 3.0]), np.ones(2)).tolist() == [2.0]
    cuts = packed.thresholds(np.arange(1000.0), np.ones(1000))
    assert len(cuts) == 31 and np.abs(np.diff(cuts) - 1000 / 32).max() < 1.5


def test_sweep_takes_the_same_passes_for_all_sizes(spark):
    """Every size and model was fitted by itself, in jobs of its own."""
    df = labelled(spark)
    train, test = df.where("g % 4 <> 0"), df.where("g % 4 = 0")
    sweep = lambda *sizes: screening.feature_sweep(train, test, ["f0", "f2", "f1", "f3"], "y", sizes, ("logistic", "boosted"))
    assert [(r["n_features"], r["model"]) for r in sweep(1, 3)] == [(n, m) for n in (1, 3) for m in ("logistic", "boosted")]
    assert jobs(spark, lambda: sweep(1, 2, 3, 4)) <= jobs(spark, lambda: sweep(4)) + 6
