"""Distinct counts of sets that move with the calendar, and of their unions, intersections and differences.

Method: theta sketches by Spark's own aggregate and set functions. A sketch of nominal size 2**8 holds at most 15/16 of
2**9 hashes while it is filled, so half the nominal size keeps what is retained within SIZE hashes; merged sketches are
trimmed to the nominal size. Each group and day is sketched once, combined before the shuffle; windows are unions of
daily sketches, and the algebra of two windows is read from those alone.

Error bounds are those of sampling at rate theta: of N members, each is retained with probability theta, so the number
retained is binomial. A sketch that samples holds its nominal size of hashes, which gives theta from its estimate; the
intersection and difference of two sketches sample at the smaller theta of both.

Exact counts stand beside the estimates. An id that is seen on a day belongs to the windows of the next days: its days
become disjoint intervals, the intervals of two groups meet within one id, and only where they begin and end is
counted, so that neither windows nor pairs of days are spelled out. Everything after the distinct rows stays in one partitioning,
by id, until the counts, whose number is that of days and groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.llm._spark import cut

#: Hashes that a sketch may hold, and the logarithm of half of that, its nominal size.
SIZE, LOG_SIZE = 512, 8
#: Standard deviations that an error bound spans.
DEVIATIONS = 3.0


def daily_sketches(rows: DataFrame) -> DataFrame:
    """kind, day and the sketch of the distinct ids of rows (id, kind, day, none of them null). No rows give no sketches."""
    return rows.groupBy("kind", "day").agg(F.theta_sketch_agg("id", F.lit(LOG_SIZE)).alias("sketch"))


def window_sketches(daily: DataFrame, days: int) -> DataFrame:
    """kind, day and the union of the sketches of the given number of days that end with that day, where there is one."""
    ends = daily.select("kind", F.explode(F.sequence(F.col("day"), F.col("day") + (days - 1))).alias("day"), "sketch")
    return ends.groupBy("kind", "day").agg(F.theta_union_agg("sketch", F.lit(LOG_SIZE)).alias("sketch"))


def bound(estimate: Column, theta: Column) -> Column:
    """How far the true number may lie above an estimate from hashes sampled at rate theta; none where all were kept.

    With n retained, N is the greatest number for which n is no more than DEVIATIONS below its mean: the root of
    N theta - z sqrt(N theta (1 - theta)) = n. The same distance holds below, where the interval is shorter.
    """
    z = F.sqrt(1 - theta) * DEVIATIONS
    root = (z + F.sqrt(z * z + 4 * estimate * theta)) / 2
    return F.when(theta >= 1, 0.0).otherwise((root * root - estimate * theta) / theta)


def algebra(a: Column, b: Column) -> dict[str, Column]:
    """est_ and err_ of union, both and only_a of two sketches; a null sketch is an empty set."""
    size = lambda s: F.coalesce(F.theta_sketch_estimate(s), F.lit(0)).cast("double")
    theta = lambda n: F.least(F.lit(1.0), F.lit(float(1 << LOG_SIZE)) / n)
    sampled = lambda n: F.when(n > 0, theta(n)).otherwise(1.0)
    union = size(F.coalesce(F.theta_union(a, b, F.lit(LOG_SIZE)), a, b))
    both = F.when(a.isNotNull() & b.isNotNull(), size(F.theta_intersection(a, b))).otherwise(0.0)
    only_a = size(F.coalesce(F.theta_difference(a, b), a))
    least = F.least(sampled(size(a)), sampled(size(b)))
    return {
        "est_union": union,
        "est_both": both,
        "est_only_a": only_a,
        "err_union": bound(union, sampled(union)),
        "err_both": F.when(a.isNotNull() & b.isNotNull(), bound(both, least)).otherwise(0.0),
        "err_only_a": F.when(a.isNull(), 0.0).when(b.isNull(), bound(only_a, sampled(size(a)))).otherwise(bound(only_a, least)),
    }


def intervals(rows: DataFrame, days: int) -> DataFrame:
    """id, kind, first and last: the disjoint intervals of days on whose window of the given length an id of kind is seen."""
    seen = rows.select("id", "kind", "day").distinct().repartition("id")
    each = W.partitionBy("id", "kind").orderBy("day")
    apart = F.coalesce((F.col("day") - F.lag("day").over(each) > days).cast("int"), F.lit(0))
    runs = seen.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(each.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("id", "kind", "_run").agg(F.min("day").alias("first"), (F.max("day") + (days - 1)).alias("last")).drop("_run")


def _per_day(spans: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, day, and how many spans (first to last) hold that day, for every day on which the number changes, and the day up to which it holds."""
    step = lambda day, n: F.struct(day.alias("day"), F.lit(n).alias("n"))
    steps = spans.select(*by, F.inline(F.array(step(F.col("first"), 1), step(F.col("last") + 1, -1))))
    changes = steps.groupBy(*by, "day").agg(F.sum("n").alias("n"))
    over = W.partitionBy(*by).orderBy("day")
    return changes.select(*by, F.col("day").alias("from"), F.coalesce(F.lead("day").over(over) - 1, F.col("day")).alias("to"), F.sum("n").over(over.rowsBetween(W.unboundedPreceding, 0)).alias(name))


def _on(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    """One row per day instead of one per stretch of equal counts."""
    return counts.where(F.col(name) > 0).select(*by, F.explode(F.sequence("from", "to")).alias("day"), name)


def window_pairs(rows: DataFrame, days: int = 7, gap: int = 1) -> DataFrame:
    """For every day with a row and every ordered pair of kinds: exact and estimated sizes of union, intersection and difference.

    rows: id, kind, day (whole numbers for days). A is kind_a's ids in the given number of days that end with the day, B
    kind_b's in as many days that end gap days before. Rows with a null in any of the three take no part; repeated rows
    count once; an empty window counts as the empty set; no rows give no rows. Columns beside those three are ignored.

    The result has a row per day and pair of kinds, so the distinct kinds, which are one value in the plan, have to be few.
    """
    used = rows.select("id", "kind", F.col("day").cast("long").alias("day")).dropna()
    daily = cut(daily_sketches(used), "daily")
    windows = window_sketches(daily, days)
    kinds = daily.agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    spine = daily.select("day").distinct().select("day", F.explode(kinds.scalar()).alias("kind_a"))
    spine = spine.select("day", "kind_a", F.explode(kinds.scalar()).alias("kind_b"))

    at = intervals(used, days)
    a = at.select(F.col("id"), F.col("kind").alias("kind_a"), F.col("first").alias("a_first"), F.col("last").alias("a_last"))
    b = at.select(F.col("id"), F.col("kind").alias("kind_b"), (F.col("first") + gap).alias("b_first"), (F.col("last") + gap).alias("b_last"))
    met = a.join(b, (a["id"] == b["id"]) & (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last")))
    shared = met.select("kind_a", "kind_b", F.greatest("a_first", "b_first").alias("first"), F.least("a_last", "b_last").alias("last"))
    n_both = _on(_per_day(shared, ["kind_a", "kind_b"], "n_both"), ["kind_a", "kind_b"], "n_both")
    n_kind = _on(_per_day(at, ["kind"], "n"), ["kind"], "n")

    side = lambda df, own, value, later: df.select((F.col("day") + later).alias("day"), F.col("kind").alias(f"kind_{own}"), F.col(value).alias(f"{value}_{own}"))
    out = spine.join(n_both, ["day", "kind_a", "kind_b"], "left")
    for own, later in (("a", 0), ("b", gap)):
        out = out.join(side(n_kind, own, "n", later), ["day", f"kind_{own}"], "left").join(side(windows, own, "sketch", later), ["day", f"kind_{own}"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    exact = {"n_union": n("n_a") + n("n_b") - n("n_both"), "n_both": n("n_both"), "n_only_a": n("n_a") - n("n_both")}
    found = {**exact, **algebra(F.col("sketch_a"), F.col("sketch_b"))}
    return out.select("day", "kind_a", "kind_b", *(c.alias(name) for name, c in found.items()))
