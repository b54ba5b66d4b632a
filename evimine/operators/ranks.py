"""Running sums, ranks and what is made of them, for tables of any size.

A window without a partition, or with one that holds a large part of the rows, is one task. Here the order is cut into ranges
first: rows are dealt out by range of the order, each range is summed up, what came before a range is a running sum over
the ranges' totals (one row per group and range), and within its range a row adds what came before it there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.sources.scratch import stored

#: How two totals become one.
_TOGETHER = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], made: Mapping[str, tuple[str, Column | str]], ranges: int | None = None) -> DataFrame:
    """df with running sums, minima or maxima up to each row (itself included), in order, within by.

    made: name of the new column to (sum, min or max, column). Rows that the order does not tell apart have to be alike or few, as
    they stay in one range; their own order is free. ranges: how many, by default the session's shuffle partitions. Nulls are
    skipped as by the aggregates, groups of null keys are groups. An empty table stays empty.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *(F.col(b).asc() for b in by), *order)
    table = stored(dealt.withColumn("_range", F.spark_partition_id()))
    kinds = {name: (kind, F.col(c) if isinstance(c, str) else c) for name, (kind, c) in made.items()}
    totals = table.groupBy(*by, "_range").agg(*(_FOLD[kind](c).alias(f"_total_{name}") for name, (kind, c) in kinds.items()))
    earlier = W.partitionBy(*(by or [F.lit(1)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.struct(*by, "_range").alias("_key"), *(_FOLD[kind](f"_total_{name}").over(earlier).alias(f"_before_{name}") for name, (kind, _) in kinds.items()))
    own = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = table.withColumns({f"_own_{name}": _FOLD[kind](c).over(own) for name, (kind, c) in kinds.items()})
    joined = inside.join(before, F.struct(*(inside[b] for b in by), inside["_range"]).eqNullSafe(F.col("_key")))
    both = lambda name, kind: F.coalesce(_TOGETHER[kind](F.col(f"_before_{name}"), F.col(f"_own_{name}")), F.col(f"_own_{name}"), F.col(f"_before_{name}"))
    return joined.select(*df.columns, *(both(name, kind).alias(name) for name, (kind, _) in kinds.items()))


def _distinct(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))


def _back(df: DataFrame, found: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with columns of its row in found, by keys that may be null."""
    side = found.select(F.struct(*keys).alias("_key"), *columns)
    return df.join(side, F.struct(*(df[k] for k in keys)).eqNullSafe(side["_key"]), "left").select(*(df[c] for c in df.columns), *columns)


def ranked(df: DataFrame, score: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """df with rank (from the greatest score; ties share the least) and points, (n - rank + 1) / n, within by.

    Null scores get neither and do not count.
    """
    values = _distinct(df.where(F.col(score).isNotNull()), by, score)
    found = running(values, by, [F.col(score).desc()], {"_upto": ("sum", "_n")}, ranges)
    n = found.groupBy(*by).agg(F.max("_upto").alias("_all"))
    sized = _back(found, n, by, ["_all"]) if by else found.crossJoin(F.broadcast(n))
    rank = F.col("_upto") - F.col("_n") + 1
    sized = sized.withColumns({"rank": rank, "points": (F.col("_all") - rank + 1) / F.col("_all")})
    return _back(df, sized, [*by, score], ["rank", "points"])


def step_up(df: DataFrame, p: str, q: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """df with step-up q-values of its p-values, for tables of any size; null p-values get none and do not count."""
    values = _distinct(df.where(F.col(p).isNotNull()), by, p)
    ranks = running(values, by, [F.col(p).asc()], {"_upto": ("sum", "_n")}, ranges)
    n = ranks.groupBy(*by).agg(F.max("_upto").alias("_all"))
    sized = _back(ranks, n, by, ["_all"]) if by else ranks.crossJoin(F.broadcast(n))
    raw = sized.withColumn("_raw", F.col(p) * F.col("_all") / F.col("_upto"))
    least = running(raw, by, [F.col(p).desc()], {"_least": ("min", "_raw")}, ranges)
    return _back(df, least.withColumn(q, F.least(F.lit(1.0), F.col("_least"))), [*by, p], [q])


def ranking_metrics(counts: DataFrame, score: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """auroc (ties count half) and average precision (step-wise over tied scores) from stats.score_counts, whatever the number of scores."""
    run = running(counts, by, [F.col(score).desc()], {"_tp": ("sum", "pos"), "_fp": ("sum", "neg")}, ranges)
    parts = run.groupBy(*by).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("neg") * (F.col("_tp") - F.col("pos") / 2.0)).alias("wins"),
        F.sum(F.col("pos") * (F.col("_tp") / (F.col("_tp") + F.col("_fp")))).alias("area"),
    )
    over = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    return parts.select(*by, over("wins", F.col("p") * F.col("n")).alias("auroc"), over("area", F.col("p")).alias("average_precision"))
