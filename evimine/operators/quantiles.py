"""Exact quantiles by narrowing: no task ever holds the values of a group.

Spark's exact percentile keeps every distinct value of a group in one buffer. Here a pass over the rows takes a grid of approximate percentiles
per group, from sketches of bounded size that are combined before the shuffle. They bracket each wanted rank. The next pass counts what lies
below the bracket and at its ends, exactly, and takes a grid of what lies between, until that has few distinct values, however many rows hold them;
then those are counted, one row each. Brackets are proved by the counts: a rank that lies outside of its bracket keeps the part of the former
bracket on its side. Every column, group and quantile goes through the same passes, those that are narrow wait: two for columns of few values
or ten million rows a group, three for some billions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.sources.scratch import FINE, kept, stored

#: Cells of a grid, values of a bracket that are counted one by one, and brackets up to which they are broadcast (some MB).
CELLS, FEW, BROADCAST = 512, 20_000, 100_000
ACCURACY = 20 * CELLS
_TARGET, _ENDS = ["key", "p", "want", "more", "part"], ["low", "high", "sure_low", "sure_high"]


def _grid(value: Column) -> Column:
    return F.percentile_approx(value, F.array(*(F.lit(i / CELLS) for i in range(CELLS + 1))), F.lit(ACCURACY))


def _with(rows: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of a group with each of its brackets; that table has a row per group and quantile, counted before it is broadcast."""
    side = F.broadcast(brackets) if brackets.count() <= BROADCAST else brackets
    key = F.struct(*(rows[b] for b in by)).eqNullSafe(F.col("key")) if by else F.lit(True)
    return rows.join(side, key & (rows["value"] <= F.col("high")))


def _proved() -> Column:
    """Whether the counts of a bracket show that the wanted ranks lie in it."""
    return (F.col("n_less") <= F.col("want")) & (F.col("want") + F.col("more") < F.col("n_less") + F.col("n_in"))


def _counts(value: Column, low: Column, high: Column) -> list[Column]:
    """What a pass tells of the rows of a bracket: how many, those at its ends and between, its first and last value, and the grid of what lies between.

    An end that many rows share would fill the grid, and the bracket would never narrow; so the ends are counted, and the grid is of the rest.
    """
    inside, between = (value >= low) & (value <= high), (value > low) & (value < high)
    own = F.when(inside, value)
    return [
        F.count_if(value < low).alias("n_less"), F.count_if(inside).alias("n_in"), F.count_if(value == low).alias("n_low"), F.count_if(between).alias("n_between"),
        F.min(own).alias("bottom"), F.max(own).alias("top"), F.approx_count_distinct(F.when(between, value)).alias("n_distinct"), _grid(F.when(between, value)).alias("grid"),
    ]


def _narrowed(counted: DataFrame) -> DataFrame:
    """Brackets after a pass (_counts). want and more are ranks among all rows of the group.

    What lies strictly between the ends gets less with every pass: a proved bracket keeps some cells of it, one that is not proved is left for the
    part of the former bracket beyond its first or last value. expected: values between the ends of the new bracket, of which repeated ones are one.
    """
    size = F.greatest(F.col("n_between") - 1, F.lit(1))
    at = (F.col("want") - F.col("n_less") - F.col("n_low")) / size * CELLS
    first, last = F.floor(at - 1).cast("int"), F.ceil(at + F.col("more") * CELLS / size + 1).cast("int")
    cell = lambda i: F.element_at("grid", F.greatest(F.lit(0), F.least(F.lit(CELLS), i)) + 1)
    upto = F.col("n_less") + F.col("n_low")
    low = F.when(F.col("want") >= upto + F.col("n_between"), F.col("high")).when(first <= 0, F.col("low")).otherwise(cell(first))
    high = F.when(F.col("want") + F.col("more") < upto, F.col("low")).when(last >= CELLS, F.col("high")).otherwise(cell(last))
    expected = F.least(F.col("n_between") * F.least(last - first + 2, F.lit(CELLS)) / CELLS, F.col("n_distinct").cast("double"))
    fresh = F.when(_proved(), F.struct(low.alias("low"), high.alias("high"), F.col("low").alias("sure_low"), F.col("high").alias("sure_high"), expected.alias("expected")))
    # the last value of a bracket may be the one that is wanted, with its next beyond; so may the first be the next of one before
    before = F.struct(F.col("sure_low").alias("low"), F.when(F.col("want") + F.col("more") < F.col("n_less"), F.col("low")).otherwise(F.coalesce("bottom", "sure_high")).alias("high"))
    beyond = F.struct(F.when(F.col("want") >= F.col("n_less") + F.col("n_in"), F.col("high")).otherwise(F.coalesce("top", "low")).alias("low"), F.col("sure_high").alias("high"))
    wide = F.when(F.col("n_less") > F.col("want"), before).otherwise(beyond)
    back = F.struct(wide["low"].alias("low"), wide["high"].alias("high"), F.col("sure_low"), F.col("sure_high"), F.lit(float("inf")).alias("expected"))
    return counted.select(*_TARGET, F.coalesce(fresh, back).alias("to")).select(*_TARGET, "to.*")


def quantiles(values: DataFrame, by: Sequence[str], probabilities: Sequence[float], value: str = "value", few: int = FEW) -> DataFrame:
    """by, p and quantile: interpolated exact quantiles of each group's values.

    values is read once per pass, so give it a table or something cheap. Nulls and NaN are no values; a group without any has no rows here; repeated
    values count each; an empty table gives no rows. Null keys are a group.
    """
    rows = values.select(*by, F.col(value).cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    key = F.struct(*(F.col(b) for b in by)) if by else F.struct(F.lit(0).alias("all"))
    ends = {name: F.lit(float(end)) for name, end in (("low", "-inf"), ("high", "inf"), ("sure_low", "-inf"), ("sure_high", "inf"))}
    sizes = rows.groupBy(*by).agg(*_counts(F.col("value"), ends["low"], ends["high"])).where("n_in > 0")
    rank = F.col("p") * (F.col("n_in") - 1)
    each = F.explode(F.array(*(F.lit(float(p)) for p in probabilities))).alias("p")
    wanted = sizes.select("*", key.alias("key"), each)
    wanted = wanted.withColumns({"want": F.floor(rank), "more": (F.ceil(rank) - F.floor(rank)).cast("long"), "part": rank - F.floor(rank)})
    brackets, parts = stored(_narrowed(wanted.withColumns(ends))), []
    uncounted = {**{c: F.lit(0).cast("long") for c in ("n_low", "n_between", "n_distinct")}, "grid": F.lit(None).cast("array<double>")}
    while True:
        while not brackets.where((F.col("expected") > few) & (F.col("low") < F.col("high"))).isEmpty():
            wide = (F.col("expected") > few) & (F.col("low") < F.col("high"))
            settled, open_ = brackets.where(~wide), brackets.where(wide)
            counts = _with(rows, open_, by).groupBy(*_TARGET, *_ENDS).agg(*_counts(F.col("value"), F.col("low"), F.col("high")))
            brackets = stored(settled.unionByName(_narrowed(counts)))
        found = stored(_read(_with(rows, brackets, by)))
        parts.append(found.where("proved"))
        if found.where("NOT proved").isEmpty():
            break
        brackets = stored(_narrowed(found.where("NOT proved").withColumns(uncounted)))
    mixed = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return reduce(DataFrame.union, parts).select(*(F.col("key")[b].alias(b) for b in by), "p", mixed.alias("quantile"))


def _read(pairs: DataFrame) -> DataFrame:
    """The values at the wanted ranks (a, and b for the next), from rows with their brackets: one row per distinct value of a bracket. proved: they lie in it."""
    inside = F.col("value") >= F.col("low")
    # what lies below counts as one value, as nothing within the bracket does
    each = pairs.groupBy(*_TARGET, *_ENDS, F.when(inside, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("key", "p").orderBy(F.col("value").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    at = lambda r: F.min(F.when(F.col("value").isNotNull() & (F.col("upto") > r), F.col("value")))
    less, all_ = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)), F.sum("n")
    found = each.withColumn("upto", upto).groupBy(*_TARGET, *_ENDS).agg(at(F.col("want")).alias("a"), at(F.col("want") + F.col("more")).alias("b"), less.alias("n_less"), (all_ - less).alias("n_in"), F.min("value").alias("bottom"), F.max("value").alias("top"))
    return found.withColumn("proved", _proved())


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float]:
    """The exact median of each named column, all in the same passes over one written table; columns without values are left out."""
    with kept(df.select(*(c.cast("double").alias(name) for name, c in columns.items())), FINE) as wide:
        long = wide.unpivot([], list(columns), "feature", "value")
        return {r["feature"]: r["quantile"] for r in quantiles(long, ["feature"], [0.5]).collect()}
