"""Profiles and audits of wide tables in long form: one row per row and feature, one shuffle for all features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.functions import stats
from evimine.operators import gram, quantiles


def long_form(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, value (double)."""
    return df.select(*keys, *(F.col(f).cast("double").alias(f) for f in features)).unpivot(keys, features, "feature", "value")


def missingness(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, n_rows, n_missing, missing_rate and n_distinct of columns of any type."""
    text = df.select(*(F.col(f).cast("string").alias(f) for f in features)).unpivot([], features, "feature", "value")
    n, some = F.count(F.lit(1)), F.count("value")
    return text.groupBy("feature").agg(n.alias("n_rows"), (n - some).alias("n_missing"), ((n - some) / n).alias("missing_rate"), F.count_distinct("value").alias("n_distinct"))


def summary(values: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, sd, quartiles (exact, interpolated) and range of long values, which are read a few times; no task holds the values of a group."""
    moments = values.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = quantiles.quantiles(values, by, list(names.values()))
    wide = found.groupBy(F.struct(*by).alias("_key")).agg(*(F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name) for name, p in names.items()))
    joined = moments.join(wide, F.struct(*by).eqNullSafe(F.col("_key")), "left")
    return joined.select(*by, "n", "mean", "sd", *names, "low", "high")


def bounds_audit(values: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """How many values of each feature lie outside its bounds (feature, lo, hi), and far outside (below lo/2, above 2 hi)."""
    joined = values.join(F.broadcast(bounds), "feature")
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    return joined.groupBy(*by, "feature").agg(
        F.count("value").alias("n"),
        F.count_if(v < lo).alias("n_below"),
        F.count_if(v > hi).alias("n_above"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.max((v < lo * 0.5) | (v > hi * 2)).cast("int").alias("extreme"),
    )


def zero_collapse(values: DataFrame, split: str = "split", least: float = 0.05) -> DataFrame:
    """Features that are often nonzero in training and never in test."""
    nonzero = (F.col("value") != 0).cast("double")
    rates = values.groupBy("feature").agg(F.avg(F.when(F.col(split) == "train", nonzero)).alias("train_nonzero"), F.avg(F.when(F.col(split) == "test", nonzero)).alias("test_nonzero"))
    return rates.withColumn("status", F.when((F.col("train_nonzero") >= least) & (F.col("test_nonzero") == 0), "collapsed").otherwise("ok"))


def balance(values: DataFrame, split: str = "split") -> DataFrame:
    """Train and test means, and the standardised difference of each feature: by rates if it only holds 0 and 1."""
    of = lambda s: F.when(F.col(split) == s, F.col("value"))
    a = values.groupBy("feature").agg(
        F.min(F.col("value").isin(0.0, 1.0)).alias("binary"),
        *(f(of(s)).alias(f"{n}_{s}") for s in ("train", "test") for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))),
    )
    numeric = stats.smd_numeric(*(F.col(f"{n}_{s}") for n in ("mean", "var", "n") for s in ("train", "test")))
    smd = F.when(F.col("binary"), stats.smd_binary(F.col("mean_train"), F.col("mean_test"))).otherwise(numeric)
    return a.select("feature", F.col("binary").cast("int").alias("binary"), "n_train", "n_test", "mean_train", "mean_test", smd.alias("smd"))


def label_signal(values: DataFrame, label: str) -> DataFrame:
    """The absolute standardised difference of each feature between rows with and without label."""
    of = lambda y: F.when(F.col(label) == y, F.col("value"))
    a = values.groupBy("feature").agg(*(f(of(y)).alias(f"{n}{y}") for y in (1, 0) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    return a.select("feature", F.abs(stats.smd_numeric(*(F.col(f"{n}{y}") for n in "mvn" for y in (1, 0)))).alias("signal"))


def binned_information(values: DataFrame, label: str, edges: DataFrame) -> DataFrame:
    """Mutual information (nats) of label and the bin of each feature's value; edges: feature and an array of cuts."""
    joined = values.join(F.broadcast(edges), "feature")
    place = F.aggregate("cuts", F.lit(0), lambda a, c: a + F.when(F.col("value") > c, 1).otherwise(0))
    cells = joined.groupBy("feature", place.alias("bin"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda *by: F.sum("n").over(W.partitionBy("feature", *by)).cast("double")
    term = F.col("n") / total() * F.ln(F.col("n") * total() / (total("bin") * total("y")))
    return cells.withColumn("t", term).groupBy("feature").agg(F.sum("t").alias("information"))


def rank_score(score: Column, within) -> tuple[Column, Column]:
    """Rank from the greatest score (ties share the least rank), and (n - rank + 1) / n."""
    rank = F.rank().over(within.orderBy(F.desc(score)))
    n = F.count(F.lit(1)).over(within)
    return rank, (n - rank + 1) / F.greatest(n, F.lit(1))


def min_max(value: Column, within) -> Column:
    low, high = F.min(value).over(within), F.max(value).over(within)
    return F.when(high - low <= 1e-12, 0.0).otherwise((value - low) / (high - low))


def fuse(rankings: DataFrame, top: int) -> DataFrame:
    """rankings: method, feature, score. Per feature: votes (methods that rank it in their top), mean rank and mean rank score."""
    within = W.partitionBy("method")
    rank, points = rank_score(F.col("score"), within)
    each = rankings.withColumns({"rank": rank, "points": points, "norm": min_max(F.col("score"), within)})
    return each.groupBy("feature").agg(F.count_if(F.col("rank") <= top).alias("votes"), F.avg("rank").alias("mean_rank"), F.avg("points").alias("mean_points"), F.avg("norm").alias("mean_norm"))


def redundancy(df: DataFrame, features: list[str]) -> DataFrame:
    """The mean absolute correlation of all pairs of features (none counts as 0), from one scan for any number of features; nulls count as 0."""
    pairs = gram.correlations(df, features)
    n = len(features) * (len(features) - 1) // 2
    found = pairs.agg(F.coalesce(F.sum(F.abs("corr")), F.lit(0.0)).alias("s"))
    return found.select((F.col("s") / max(1, n)).alias("redundancy"), F.lit(n).cast("long").alias("n_pairs"))


def herfindahl(df: DataFrame, by: list[str], category: str) -> DataFrame:
    """Concentration of categories: the sum of squared shares."""
    n = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(1)))
    return n.withColumn("s", share * share).groupBy(*by).agg(F.sum("s").alias("herfindahl"), F.count(F.lit(1)).alias("n_categories"))
