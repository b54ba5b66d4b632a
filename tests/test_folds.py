"""Stratified folds of whole groups."""

import random

from pyspark.sql import functions as F

from evimine.operators import folds


def made(spark, groups, seed):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        rate = r.choice((0.02, 0.1, 0.6, 0.95))
        rows += [(g, int(r.random() < rate)) for _ in range(min(60, int(r.paretovariate(1.1))))]
    return spark.createDataFrame(rows, "g long, y int").repartition(4)


def test_groups_stay_whole_and_folds_are_alike(spark):
    df = made(spark, 1500, 1)
    placed = df.join(folds.assign(df, "g", "y"), "g")
    per_group = placed.groupBy("g").agg(F.count_distinct("fold").alias("k"))
    assert per_group.count() == 1500 and per_group.where("k > 1").isEmpty() and placed.count() == df.count()
    by_fold = {r.fold: r for r in placed.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).collect()}
    rate, n = df.agg(F.avg("y"), F.count(F.lit(1))).first()
    assert set(by_fold) == set(range(5))
    assert all(abs(r.rate - rate) < 0.005 and abs(r.n - n / 5) < 0.02 * n for r in by_fold.values())


def test_seeds_differ_and_reruns_agree(spark):
    df = made(spark, 200, 2)
    first, again, other = ({r.g: r.fold for r in folds.assign(df, "g", "y", seed=s).collect()} for s in (1, 1, 2))
    assert first == again and first != other


def test_quotas_are_greedy():
    """One large mixed group per fold first, then what is left where it helps."""
    found = folds.quotas([(10, 5, 2), (1, 0, 5), (1, 1, 3)], 2)
    assert found[10, 5] == [1, 1] and sorted(found[1, 0]) == [2, 3] and sorted(found[1, 1]) == [1, 2]
    assert folds.quotas([], 3) == {}


def test_shapes_are_bounded(spark):
    n = spark.range(1, 200_000).select(folds._coarse(F.col("id")).alias("c"), F.col("id"))
    assert n.select("c").distinct().count() < 32 + 16 * 14 and n.where("c > id OR c < id * 0.9").isEmpty()


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 1), (2, 0)], "g long, y int")
    assert {r.g for r in folds.assign(df, "g", "y").collect()} == {1, 2}
    assert folds.assign(df.where("false"), "g", "y").count() == 0
