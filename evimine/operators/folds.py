"""Folds that keep groups whole and have the same share of rows and of the label.

Groups matter to the balance only by their rows and positives, so they are counted by that shape first: a table that is bounded by the
shapes, not by the groups. Every fold gets an equal number of groups of each shape; those that are left over go, one by one and
the most uneven shapes first, to the fold where they raise the variance of the folds' positives and negatives least. Which groups of a shape
a fold gets is decided by their place in a seeded order, which ranges count off (ranks.running), so no task holds a shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimine.operators import ranks
from evimine.sources.scratch import stored

#: Rows up to which a group has a shape of its own; above, sizes are told apart by their first five binary digits.
EXACT = 32


def _coarse(n: Column) -> Column:
    """n itself if small, else n without all but its five highest bits: at most 16 values per doubling."""
    low = F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int") - 4
    return F.when(n <= EXACT, n).otherwise(F.call_function("shiftleft", F.call_function("shiftright", n, low), low))


def quotas(shapes: list[tuple[int, int, int]], folds: int) -> dict[tuple[int, int], list[int]]:
    """Groups of each shape per fold, from (rows, positives, groups of that shape)."""
    negatives, positives = (sum(m * (n - y) for n, y, m in shapes), sum(m * y for _, y, m in shapes))
    scale = [float(t) * float(t) or 1.0 for t in (negatives, positives)]
    each = {(n, y): m // folds for n, y, m in shapes}
    held = [[sum(each[n, y] * (n - y) for n, y, _ in shapes)] * folds, [sum(each[n, y] * y for n, y, _ in shapes)] * folds]
    out = {shape: [k] * folds for shape, k in each.items()}
    for n, y, m in sorted(shapes, key=lambda s: (-abs(s[0] - 2 * s[1]), -s[0], -s[1])):
        for _ in range(m % folds):
            cost = [held[0][f] * (n - y) / scale[0] + held[1][f] * y / scale[1] for f in range(folds)]
            f = cost.index(min(cost))
            held[0][f] += n - y
            held[1][f] += y
            out[n, y][f] += 1
    return out


def assign(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """group and fold (0 to folds - 1) of every group of df; label is 0 or 1, null counts as 0.

    Rows without group have no fold. The number of groups of a fold differs by less than the number of shapes; an empty table gives no rows.
    """
    named = df.where(F.col(group).isNotNull())
    sizes = named.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("_y"))
    shaped = stored(sizes.withColumns({"_n": _coarse(F.col("_n")), "_y": F.least(_coarse(F.col("_n")), _coarse(F.col("_y")))}))
    found = [tuple(r) for r in shaped.groupBy("_n", "_y").agg(F.count(F.lit(1)).alias("m")).collect()]
    spark = df.sparkSession
    ends = [(n, y, [sum(q[: f + 1]) for f in range(folds)]) for (n, y), q in quotas(found, folds).items()]
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))
    placed = ranks.running(shaped.withColumn("_place", place), ["_n", "_y"], [F.col("_place").asc()], {"_at": ("sum", F.lit(1))})
    side = spark.createDataFrame(ends, "_n long, _y long, _ends array<long>")
    return placed.join(side, ["_n", "_y"]).select(group, F.size(F.filter("_ends", lambda e: e < F.col("_at"))).alias("fold"))
