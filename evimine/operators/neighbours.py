"""Mutual information of numbers and a class, estimated from nearest neighbours.

For every row: the distance to its k-th nearest neighbour of the same class, then the number of rows of any class that lie nearer. With
psi the digamma function, information = psi(N) + mean psi(k) - mean psi(rows of the class) - mean psi(rows nearer, itself included).

Rows of one class and value are alike, so the work is on distinct values with their counts. Neighbours: values of a class in order
(ranks.running gives their places) are cut into blocks, and the k values on each side of a border are copied across it, so that every block finds its
neighbours alone. Rows nearer: counts up to the two ends of each neighbourhood, read from one running sum over values and ends of a feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.functions.stats import digamma
from evimine.operators import ranks
from evimine.sources.scratch import stored

#: Values of a block.
BLOCK = 4096


def _kth_distances(values: DataFrame, k: int, block: int, ranges: int | None) -> DataFrame:
    """values (feature, label, value, n, k) with radius: how far the k-th nearest row of the class is."""
    placed = ranks.running(values, ["feature", "label"], [F.col("value").asc()], {"place": ("sum", F.lit(1))}, ranges)
    own, at = F.floor((F.col("place") - 1) / block), (F.col("place") - 1) % block
    copies = F.array_compact(F.array(own, F.when(at < k, own - 1), F.when(at >= block - k, own + 1)))
    spread = placed.select("*", own.alias("own"), F.explode(copies).alias("block"))
    order = W.partitionBy("feature", "label", "block").orderBy("place")
    near = lambda c, j: F.lag(c, j).over(order) if j > 0 else F.lead(c, -j).over(order)
    steps = [j for i in range(1, k + 1) for j in (i, -i)]
    # entries (distance, rows there), nearest first; those of the same value come before all
    entries = F.array(*(F.struct(F.abs(near("value", j) - F.col("value")).alias("far"), near("n", j).alias("n")) for j in steps))
    with_entries = spread.withColumn("entries", F.array_sort(F.filter(entries, lambda e: e["far"].isNotNull()))).where("block = own")
    still = F.struct((F.col("k") - F.col("n") + 1).alias("left"), F.lit(0.0).alias("far"))
    step = lambda a, e: F.when(a["left"] > 0, F.struct((a["left"] - e["n"]).alias("left"), e["far"].alias("far"))).otherwise(a)
    return with_entries.select("feature", "label", "value", "n", "k", F.aggregate("entries", still, step)["far"].alias("radius"))


def _counted_within(rows: DataFrame, ranges: int | None) -> DataFrame:
    """rows with m: rows of the feature that lie nearer than radius, or at the same value if that is 0."""
    apart = F.col("radius") > 0
    # what sorts at one value: ends that it does not count for, the value, ends that it counts for
    low, high = F.struct((F.col("value") - F.col("radius")).alias("x"), F.when(apart, 2).otherwise(0).alias("o")), F.struct((F.col("value") + F.col("radius")).alias("x"), F.when(apart, 0).otherwise(2).alias("o"))
    ended = stored(rows.withColumns({"low": low, "high": high}))
    point = ended.select("feature", F.col("value").alias("x"), F.lit(1).alias("o"), "n")
    ends = ended.select("feature", F.explode(F.array("low", "high")).alias("e")).select("feature", "e.x", "e.o", F.lit(0).cast("long").alias("n"))
    places = point.union(ends).groupBy("feature", "x", "o").agg(F.sum("n").alias("n"))
    upto = stored(ranks.running(places, ["feature"], [F.col("x").asc(), F.col("o").asc()], {"upto": ("sum", "n")}, ranges).where("o <> 1"))
    side = lambda name: upto.select("feature", F.struct("x", "o").alias(name), F.col("upto").alias(f"upto_{name}"))
    return ended.join(side("low"), ["feature", "low"]).join(side("high"), ["feature", "high"]).withColumn("m", F.col("upto_high") - F.col("upto_low"))


def mutual_information(values: DataFrame, k: int = 3, block: int = BLOCK, ranges: int | None = None) -> DataFrame:
    """feature and information (nats, at least 0) of values (feature, value, label).

    Nulls and NaN, in value or label, are left out, and so are classes of one row; a class of k rows or fewer uses all its other rows. A
    feature without two rows of a class has no row here. Ties count as they are: nothing is added to break them.
    """
    some = values.where("value IS NOT NULL AND NOT isnan(value) AND label IS NOT NULL AND feature IS NOT NULL")
    distinct = stored(some.groupBy("feature", "label", F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    classes = distinct.groupBy("feature", "label").agg(F.sum("n").alias("n_class")).where("n_class > 1")
    sized = distinct.join(classes, ["feature", "label"]).withColumn("k", F.least(F.lit(k), F.col("n_class") - 1))
    found = _counted_within(_kth_distances(sized.select("feature", "label", "value", "n", "k"), k, block, ranges), ranges)
    psi = lambda c: digamma(F.col(c).cast("double"))
    per_class = found.groupBy("feature", "label").agg(F.sum("n").alias("n_class"), F.sum(F.col("n") * (psi("k") - psi("m"))).alias("part"))
    total = per_class.groupBy("feature").agg(F.sum("n_class").alias("n"), F.sum(F.col("part") - F.col("n_class") * psi("n_class")).alias("sum"))
    return total.select("feature", F.greatest(F.lit(0.0), psi("n") + F.col("sum") / F.col("n")).alias("information"))


def oracle(rows: str, k: int = 3) -> str:
    """The same in SQL from a table expression with feature, value and label."""
    entries = ", ".join(f"{{'far': abs({w}(value, {j}) OVER o - value), 'n': {w}(n, {j}) OVER o}}" for j in range(1, k + 1) for w in ("lag", "lead"))
    reach = "list_filter(range(1, len(es) + 1), lambda i: list_sum([one.n FOR one IN es[1:i]]) >= k - n + 1)[1]"
    return f"""WITH d AS (SELECT feature, label, value::DOUBLE AS value, count(*)::BIGINT AS n FROM {rows} WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY feature, label)::BIGINT AS n_class FROM d),
z AS (SELECT *, least({k}, n_class - 1) AS k FROM c WHERE n_class > 1),
e AS (SELECT *, list_sort(list_filter([{entries}], lambda one: one.far IS NOT NULL)) AS es FROM z WINDOW o AS (PARTITION BY feature, label ORDER BY value)),
r AS (SELECT *, CASE WHEN n > k THEN 0 ELSE es[{reach}].far END AS radius FROM e),
p AS (SELECT feature, value AS x, sum(n)::BIGINT AS n FROM r GROUP BY ALL), u AS (SELECT feature, x, sum(n) OVER (PARTITION BY feature ORDER BY x)::BIGINT AS upto, n FROM p),
q AS (SELECT r.*, value - radius AS lo, value + radius AS hi FROM r),
a AS (SELECT q.*, coalesce(u.upto, 0) AS upto_lo, CASE WHEN u.x = q.lo THEN u.n ELSE 0 END AS at_lo FROM q ASOF LEFT JOIN u ON q.feature = u.feature AND q.lo >= u.x),
b AS (SELECT a.*, u.upto AS upto_hi, CASE WHEN u.x = a.hi THEN u.n ELSE 0 END AS at_hi FROM a ASOF LEFT JOIN u ON a.feature = u.feature AND a.hi >= u.x),
m AS (SELECT *, CASE WHEN radius > 0 THEN upto_hi - at_hi - upto_lo ELSE upto_hi - upto_lo + at_lo END AS m FROM b),
h AS (SELECT i, coalesce(sum(1.0::DOUBLE / nullif(i - 1, 0)) OVER (ORDER BY i), 0) AS psi FROM range(1, (SELECT max(t) + 2 FROM (SELECT sum(n) AS t FROM z GROUP BY feature))::BIGINT) r(i)),
g AS (SELECT feature, sum(n) AS total, sum(n * (hk.psi - hm.psi - hc.psi)) / sum(n) AS rest FROM m JOIN h hk ON hk.i = m.k JOIN h hm ON hm.i = m.m JOIN h hc ON hc.i = m.n_class GROUP BY feature)
SELECT feature, greatest(0::DOUBLE, psi + rest) AS information FROM g JOIN h ON h.i = g.total"""
