"""Assembling one cohort from several tables: deterministic de-duplication, left-biased and counterpart joins, overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.functions.text import digits


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key (null keys are a key of their own), the first in a total order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def completeness(columns: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def keep_most_complete(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the one with most values, ties by order."""
    return keep_first(df, keys, [F.desc(completeness([c for c in df.columns if c not in keys])), *order])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns))


def left_biased(base: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Left join that takes nothing from other that base already has."""
    return base.join(other.drop(*(c for c in other.columns if c in base.columns and c not in on)), on, "left")


def join_by_available(base: DataFrame, other: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """left_biased on those of keys that other has, its first row of each only."""
    on = [k for k in keys if k in other.columns]
    return left_biased(base, keep_first(other, on, order), on)


def role_priority(own: Column, other: Column) -> Column:
    """Which counterpart a party prefers: 0 a vulnerable one's other kind, 1 the reverse, 2 its own kind."""
    return F.when(own & ~other, 0).when(~own & other, 1).otherwise(2)


def counterpart(parties: DataFrame, group: str, party: str, vulnerable: Column, order: list[Column]) -> DataFrame:
    """For each party of a group with others, the one it prefers: columns group, party, vulnerable, other_<column>, other_vulnerable.

    A vulnerable party prefers one that is not, and the reverse; else the first in order, which speaks of the columns of
    parties. Parties are compared by name, so one that is listed twice, even in two roles, is never its own counterpart.
    Of each kind only a group's first two parties can be anyone's choice, so a party meets four rows at most, and a
    group costs the number of its parties, not its square.
    """
    once = keep_first(parties.withColumn("_v", F.coalesce(vulnerable, F.lit(False))), [group, party, "_v"], order)
    placed = once.withColumn("_place", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    first = placed.withColumn("_k", F.row_number().over(W.partitionBy(group, "_v").orderBy("_place"))).where("_k <= 2").drop("_k")
    names = [c for c in parties.columns if c != group]
    other = F.struct(*(F.col(c).alias(f"other_{c}") for c in names), F.col("_v").alias("other_vulnerable"))
    choices = first.select(group, F.col(party).alias("_other"), F.col("_v").alias("_ov"), F.col("_place").alias("_op"), other.alias("_row"))
    pairs = placed.select(group, party, "_v").join(choices, group).where(F.col(party) != F.col("_other"))
    preferred = F.struct(role_priority(F.col("_v"), F.col("_ov")), F.col("_op"))
    best = pairs.groupBy(group, party).agg(F.min_by(F.struct(F.col("_v").alias("vulnerable"), "_row"), preferred).alias("_best"))
    return best.select(group, party, "_best.vulnerable", "_best._row.*")


def recorded_counterpart(records: DataFrame, parties: DataFrame, group: str, party: str, opponent: Column, numbers: list[Column], vulnerable: Column, unnumbered: int = 9999) -> DataFrame:
    """For each party with a usable record, the opponent that it names: columns group, party, vulnerable, other_party, other_vulnerable.

    The first number in the text of opponent names the other party; records without one, with 0 or with the party itself
    are left out. The roles of both are looked up in parties (null if unknown), and of several records the preferred
    pair of roles wins, then the smaller collision numbers (unnumbered if there is none), then the opponent's name.
    """
    named = records.withColumn("other_party", digits(opponent))
    named = named.where(F.col("other_party").isNotNull() & (F.col("other_party") != "0") & (F.col("other_party") != F.col(party).cast("string")))
    placed = [F.coalesce(digits(n).cast("double"), F.lit(float(unnumbered))).alias(f"_n{i}") for i, n in enumerate(numbers)]
    named = named.select(group, party, "other_party", *placed)
    roles = parties.select(group, F.col(party).alias("_p"), F.coalesce(vulnerable, F.lit(False)).alias("_v")).distinct()
    own = roles.select(group, F.col("_p").alias(party), F.col("_v").alias("vulnerable"))
    other = roles.select(group, F.col("_p").cast("string").alias("other_party"), F.col("_v").alias("other_vulnerable"))
    both = named.join(own, [group, party], "left").join(other, [group, "other_party"], "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    order = [role_priority(known("vulnerable"), known("other_vulnerable")), *(f"_n{i}" for i in range(len(numbers))), "other_party", F.desc_nulls_last("vulnerable"), F.desc_nulls_last("other_vulnerable")]
    return keep_first(both, [group, party], order).select(group, party, "vulnerable", "other_party", "other_vulnerable")


def overlay(base: DataFrame, exact: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """base with the values of columns from exact where it has them; exact adds no rows."""
    other = exact.select(*on, *(F.col(c).alias(f"_exact_{c}") for c in columns))
    joined = base.join(other, on, "left")
    return joined.select(*(F.coalesce(f"_exact_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def two_tier(base: DataFrame, fine: DataFrame, fine_on: list[str], coarse: DataFrame, coarse_on: list[str], columns: list[str]) -> DataFrame:
    """base with columns by the fine key, nulls filled by the coarse key."""
    a = fine.select(*fine_on, *(F.col(c).alias(f"_fine_{c}") for c in columns))
    b = coarse.select(*coarse_on, *(F.col(c).alias(f"_coarse_{c}") for c in columns))
    joined = base.join(a, fine_on, "left").join(b, coarse_on, "left")
    return joined.select(*base.columns, *(F.coalesce(f"_fine_{c}", f"_coarse_{c}").alias(c) for c in columns))


def flow(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, name, n_before, n_after of successive filters, in one pass."""
    passed = [reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for _, c in steps[: i + 1])) for i in range(len(steps))]
    counts = df.agg(F.count(F.lit(1)).alias("c0"), *(F.count_if(p).alias(f"c{i + 1}") for i, p in enumerate(passed)))
    rows = F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.col(f"c{i}").alias("n_before"), F.col(f"c{i + 1}").alias("n_after")) for i, (name, _) in enumerate(steps)))
    return counts.select(F.inline(rows))


def selected(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    return reduce(lambda d, step: d.where(step[1]), steps, df)


def key_audit(stages: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Per stage: rows, columns and distinct keys of every prefix of keys."""
    parts = []
    for name, df in stages:
        counts = [F.count_distinct(F.struct(*keys[: i + 1])).alias(f"n_keys_{i + 1}") for i in range(len(keys))]
        parts.append(df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), *counts))
    return reduce(DataFrame.unionByName, parts)


def prune(df: DataFrame, drop: tuple[str, ...] = (), fragments: tuple[str, ...] = (), protect: tuple[str, ...] = (), prefixes: tuple[str, ...] = ("FEATURE_", "VEH_FEATURE_")) -> DataFrame:
    """df without the named columns and those that hold a fragment; protected names and prefixes win."""
    gone = [c for c in df.columns if c not in protect and not c.startswith(prefixes) and (c in drop or any(f in c for f in fragments))]
    return df.drop(*gone)
