"""Statistics as column expressions and windows over small result tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1; null for an empty total."""
    n, p = total.cast("double"), hits / total
    scale = 1 + z * z / n
    center = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    some = total > 0
    return F.when(some, F.greatest(F.lit(0.0), center - half)), F.when(some, F.least(F.lit(1.0), center + half))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series eight steps up, and the recurrence back."""
    up = x + 8
    series = sum(
        (F.lit(c) / F.pow(up, F.lit(float(k))) for c, k in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7))),
        (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi),
    )
    return series - sum((F.ln(x + i) for i in range(8)), F.lit(0.0))


def digamma(x: Column) -> Column:
    """The derivative of ln Gamma at x >= 1: the asymptotic series eight steps up, and the recurrence back."""
    up = x + 8
    series = sum((F.lit(c) / F.pow(up, F.lit(float(k))) for c, k in ((-1 / 12, 2), (1 / 120, 4), (-1 / 252, 6), (1 / 240, 8))), F.ln(up) - F.lit(0.5) / up)
    return series - sum((F.lit(1.0) / (x + i) for i in range(8)), F.lit(0.0))


def binomial_tail(hits: Column, total: Column, rate: Column) -> Column:
    """P(X >= hits) for X of total trials at rate: an exact sum over the terms that matter in double precision.

    Terms further than 45 standard deviations from the mean are below the smallest double, so the number of terms
    grows with the root of total only.
    """
    p = F.least(F.greatest(rate, F.lit(1e-12)), F.lit(1 - 1e-12))
    n, mean = total.cast("double"), total * p
    reach = 45 * F.sqrt(mean * (1 - p)) + 60
    low = F.greatest(hits.cast("long"), F.ceil(mean - reach).cast("long"), F.lit(0).cast("long"))
    high = F.least(total.cast("long"), F.ceil(F.greatest(mean, hits.cast("double")) + reach).cast("long"))
    start = low.cast("double")
    first = log_gamma(n + 1) - log_gamma(start + 1) - log_gamma(n - start + 1) + start * F.ln(p) + (n - start) * F.log1p(-p)
    zero = F.struct(F.exp(first).alias("term"), F.lit(0.0).alias("sum"))
    odds = p / (1 - p)
    step = lambda a, i: F.struct((a["term"] * (n - i) / (i + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(low, high), zero, step, lambda a: F.least(F.lit(1.0), a["sum"]))
    return F.when(total > 0, F.when(low > high, 0.0).otherwise(tail))


def benjamini_hochberg(df: DataFrame, p: str, q: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with step-up q-values of its p-values; null p-values get none and do not count. For result tables of bounded size."""
    some = F.col(p).isNotNull()
    within = W.partitionBy(*by, some) if by else W.partitionBy(some)
    rank = F.row_number().over(within.orderBy(p))
    m = F.count(F.lit(1)).over(within)
    ranked = df.withColumn("_q", F.col(p) * m / rank).withColumn("_r", rank)
    back = within.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn(q, F.when(some, F.least(F.lit(1.0), F.min("_q").over(back)))).drop("_q", "_r")


def smd_numeric(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column, n_a: Column, n_b: Column) -> Column:
    pooled = F.sqrt((var_a + var_b) / 2)
    return F.when((n_a < 2) | (n_b < 2), None).when(pooled <= 1e-12, 0.0).otherwise((mean_a - mean_b) / pooled)


def smd_binary(rate_a: Column, rate_b: Column) -> Column:
    pooled = F.sqrt((rate_a * (1 - rate_a) + rate_b * (1 - rate_b)) / 2)
    return F.when(pooled <= 1e-12, 0.0).otherwise((rate_a - rate_b) / pooled)


def score_counts(scored: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives of each distinct score: all that ranking metrics need, combined before the shuffle."""
    return scored.groupBy(*by, score).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))


def ranking_metrics(counts: DataFrame, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """auroc (ties count half) and average precision (step-wise over tied scores) from score_counts."""
    within = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    down = within.orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    run = counts.withColumns({"_tp": F.sum("pos").over(down), "_fp": F.sum("neg").over(down)})
    parts = run.groupBy(*by).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("neg") * (F.col("_tp") - F.col("pos") / 2.0)).alias("wins"),
        F.sum(F.col("pos") * (F.col("_tp") / (F.col("_tp") + F.col("_fp")))).alias("area"),
    )
    return parts.select(*by, (F.col("wins") / (F.col("p") * F.col("n"))).alias("auroc"), (F.col("area") / F.col("p")).alias("average_precision"))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.5) -> Column:
    b = beta * beta
    return F.coalesce((1 + b) * tp / F.nullif((1 + b) * tp + b * fn + fp, F.lit(0.0)), F.lit(0.0))
