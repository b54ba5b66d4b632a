"""Bounded, imputed and one-hot encoded matrices. Everything learned is fitted on training rows and applied as it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.functions.text import contains_any, is_binary_like, observed_number, sentinel, within
from evimine.operators import quantiles

# Names (by fragment) and physical bounds of engineering quantities.
PHYSICAL_BOUNDS = {
    "V0": (0.0, 250.0), "VK": (0.0, 250.0), "MUE": (0.0, 1.2), "GROESP": (30.0, 250.0), "GEWP": (2.0, 200.0),
    "LAENGE": (300.0, 25000.0), "BREITE": (500.0, 3500.0), "HOEHE": (500.0, 4500.0),
    "ALTER1": (0.0, 120.0), "FEATURE_AGE_YEARS": (0.0, 120.0), "TEMP": (-50.0, 60.0),
}
# Other spellings of vehicle dimensions, which come before all other names; a fragment and the name part that it is not; quantities without bounds.
DIMENSIONS = {"LAENGE": ("LAENGE", "LÄNGE", "车长"), "BREITE": ("BREITE", "车宽"), "HOEHE": ("HOEHE", "车高")}
NOT_BOUNDED = {"VK": "VKREG"}
UNBOUNDED = ("STOSS", "碰撞角度")


def _bound_rules() -> list[tuple[tuple[str, ...], str | None, tuple[float, float]]]:
    """Fragments, a fragment that forbids the rule, and bounds, in order; the first that a name meets holds."""
    first = [(words, None, PHYSICAL_BOUNDS[k]) for k, words in DIMENSIONS.items()]
    return first + [((k,), NOT_BOUNDED.get(k), b) for k, b in PHYSICAL_BOUNDS.items() if k not in DIMENSIONS]


def bound_of(name: str) -> tuple[float, float] | None:
    upper = name.upper()
    return next((b for words, lacks, b in _bound_rules() if any(w in upper for w in words) and not (lacks and lacks in upper)), None)


def is_vehicle_dimension(name: str) -> bool:
    return any(w in name.upper() for words in DIMENSIONS.values() for w in words)


def is_engineering(name: str) -> bool:
    """Whether a name is that of a continuous engineering quantity, bounded or not."""
    return is_vehicle_dimension(name) or any(w in name.upper() for w in (*PHYSICAL_BOUNDS, *UNBOUNDED))


def name_bounds(name: Column) -> dict[str, Column]:
    """The same for a column of names: lo and hi (null without bounds), and whether a name is a vehicle's dimension and an engineering quantity."""
    upper = F.upper(name)
    low = high = F.when(F.lit(False), F.lit(0.0))
    for words, lacks, (lo, hi) in _bound_rules():
        met = contains_any(upper, words) & ~contains_any(upper, (lacks,)) if lacks else contains_any(upper, words)
        low, high = low.when(met, lo), high.when(met, hi)
    dimension = contains_any(upper, tuple(w for words in DIMENSIONS.values() for w in words))
    return {"lo": low, "hi": high, "is_dimension": dimension, "is_engineering": dimension | contains_any(upper, (*PHYSICAL_BOUNDS, *UNBOUNDED))}


def split_by_group(group: Column, test_share: int = 5) -> Column:
    """`test` for one group in test_share, the same for all rows of a group."""
    return F.when(group % test_share == 0, "test").otherwise("train")


def split_by_hash(group: Column, test_percent: int = 20, seed: int = 42) -> Column:
    """The same for groups of any type."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), group), F.lit(100)) < test_percent, "test").otherwise("train")


def choose_split(df: DataFrame, group: str, label: str, folds: int = 5, seeds: int = 5) -> tuple[int, int]:
    """The seed and fold whose rows come nearest to a fold's share, at the label's rate; groups stay whole."""
    per_group = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("y"))
    total = per_group.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    seed = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")
    placed = per_group.select("n", "y", group, seed).withColumn("fold", F.pmod(F.xxhash64("seed", group), F.lit(folds)))
    sums = placed.groupBy("seed", "fold").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    off = F.abs(F.col("n") - total["n"] / folds) + 100 * F.abs(F.col("y") / F.col("n") - total["y"] / total["n"])
    best = sums.orderBy(off, "seed", "fold").first()
    return best["seed"], best["fold"]


@dataclass(frozen=True)
class Fitted:
    """What transform needs: bounds and medians of numbers, levels of categories."""

    bounds: dict[str, tuple[float, float]]
    medians: dict[str, float]
    levels: dict[str, list[str]]


def fit(train: DataFrame, numbers: dict[str, tuple[float, float]], categories: list[str]) -> Fitted:
    """Exact medians of the clipped numbers (0 if all are null) in the same few passes; every level of each category, as each becomes a column."""
    medians = quantiles.medians(train, {c: clipped(F.col(c), b) for c, b in numbers.items()}) if numbers else {}
    levels = {}
    for c in categories:
        found = train.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("l")).distinct()
        levels[c] = sorted(r["l"] for r in found.collect())
    return Fitted(dict(numbers), {c: medians.get(c, 0.0) for c in numbers}, levels)


def clipped(value: Column, bounds: tuple[float, float]) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), value)))


def transform(df: DataFrame, fitted: Fitted, keep: list[str]) -> DataFrame:
    """keep, clipped and imputed numbers, and one 0/1 column per training level; other levels give zeros only."""
    numbers = [F.coalesce(clipped(F.col(c), b), F.lit(fitted.medians[c])).alias(c) for c, b in fitted.bounds.items()]
    dummies = [F.coalesce((F.col(c).cast("string") == level).cast("int"), F.lit(0)).alias(f"{c}_{level}") for c, levels in fitted.levels.items() for level in levels]
    return df.select(*keep, *numbers, *dummies)


def observed_flags(df: DataFrame, codes: dict[str, tuple[float, ...]], keep: list[str]) -> DataFrame:
    """keep and, per column, 1 where nothing was observed: the raw value is null, says so by its text or a code of its feature, or holds no number."""
    return df.select(*keep, *(observed_number(F.col(c), v).isNull().cast("int").alias(c) for c, v in codes.items()))


def unobserved_audit(df: DataFrame, codes: dict[str, tuple[float, ...]], by: list[str]) -> DataFrame:
    """Per group and feature: rows, those whose raw value says that nothing was observed and their rate, and those without a number afterwards. One scan, no row is multiplied."""
    counts = [c for k, v in codes.items() for c in (F.count_if(sentinel(F.col(k), v)).alias(f"s_{k}"), F.count_if(observed_number(F.col(k), v).isNull()).alias(f"m_{k}"))]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    each = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(f"s_{k}").alias("n_sentinel"), F.col(f"m_{k}").alias("n_missing_after")) for k in codes))
    return wide.select(*by, "n_rows", F.inline(each)).withColumn("sentinel_rate", F.col("n_sentinel") / F.col("n_rows"))


def unseen_levels(train: DataFrame, test: DataFrame, categories: list[str]) -> DataFrame:
    """feature and level of test that training does not have."""
    as_long = lambda d: d.select(*(F.col(c).cast("string").alias(c) for c in categories)).unpivot([], categories, "feature", "level").where("level IS NOT NULL").distinct()
    return as_long(test).join(as_long(train), ["feature", "level"], "left_anti")


class LeakageError(ValueError):
    """Something fitted saw test rows."""


def require_training_only(df: DataFrame, split: str = "split") -> DataFrame:
    """df itself; raises if it holds rows that are not for training."""
    if not df.where(~F.col(split).eqNullSafe(F.lit("train"))).isEmpty():
        raise LeakageError(f"rows of another {split} than train reach a fit")
    return df


def find_column(columns: list[str], candidates: list[str], fragments: list[str]) -> str:
    """The first candidate there is, else the first column that holds a fragment."""
    for c in candidates:
        if c in columns:
            return c
    for c in columns:
        if any(f in c for f in fragments):
            return c
    raise KeyError(f"none of {candidates}, and no name with any of {fragments}")


def column_roles(train: DataFrame, skip: list[str]) -> dict[str, str]:
    """engineering (by name), numeric (numbers beyond 0 and 1) or categorical, by names and one pass over train."""
    columns = [f for f in train.schema.fields if f.name not in skip]
    row = train.agg(*(is_binary_like(F.col(f.name)).alias(str(i)) for i, f in enumerate(columns))).first()
    numbers = ("byte", "short", "int", "bigint", "long", "integer", "float", "double")
    roles = {}
    for i, f in enumerate(columns):
        number = f.dataType.simpleString() in numbers
        roles[f.name] = "engineering" if is_engineering(f.name) else "numeric" if number and not row[str(i)] else "categorical"
    return roles


def clean_matrix(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep and features as doubles; what is no finite number counts 0."""
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda c: F.when(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), number(c))
    return df.select(*keep, *(F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in features))


def unique_names(names: DataFrame, name: str = "name", place: str = "place") -> DataFrame:
    """names with `unique_name`: the second and later of one name, in order of place, get `__dup1`, `__dup2`, ..."""
    again = F.row_number().over(W.partitionBy(name).orderBy(place)) - 1
    return names.withColumn("unique_name", F.when(again == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__dup"), again.cast("string"))))


def with_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with exactly these columns; those that it lacks are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def over_age(age: Column, limit: float = 60.0) -> Column:
    """1 above the limit, 0 else and where the age is unknown."""
    return F.coalesce(age > limit, F.lit(False)).cast("int")


def over_age_audit(df: DataFrame, raw: str, split: str = "split", limit: float = 60.0, codes: tuple[float, ...] = ()) -> DataFrame:
    """Per split: rows, those over the limit and those of unknown age (null, no number, a code for unknown or out of 0 to 120), and their shares. One scan."""
    age = within(observed_number(F.col(raw), codes), 0, 120)
    n = F.count(F.lit(1))
    over, unknown = F.sum(over_age(age, limit)), F.count_if(age.isNull())
    return df.groupBy(split).agg(n.alias("n_rows"), over.cast("long").alias("n_over"), (over / n).alias("over_rate"), unknown.alias("n_unknown"), (unknown / n).alias("unknown_rate"))


class FlagsError(ValueError):
    """Flags do not match the rows that they belong to."""


def with_flags(rows: DataFrame, flags: DataFrame | None, sources: list[str], strict: bool = True, row_id: str = "row_id") -> DataFrame:
    """rows with one boolean `_unobserved_<source>` per source, from 0/1 flags that belong to rows by row_id.

    strict: no flags, other rows than those, or flags of a column that rows lack raise. Else absent flags and columns say that a value was observed.
    A flag that is null, or that a row lacks, says that it was not.
    """
    if flags is None:
        if strict:
            raise FlagsError("no flags")
        return rows.withColumns({f"_unobserved_{s}": F.lit(False) for s in sources})
    if strict:
        require_flags(rows, flags, row_id)
    have = [s for s in sources if s in flags.columns]
    joined = rows.join(flags.select(row_id, *(F.col(s).alias(f"_unobserved_{s}") for s in have)), row_id, "left")
    told = {f"_unobserved_{s}": F.coalesce(F.col(f"_unobserved_{s}") != 0, F.lit(True)) if s in have else F.lit(False) for s in sources}
    return joined.withColumns(told)


def require_flags(rows: DataFrame, flags: DataFrame, row_id: str = "row_id") -> DataFrame:
    """flags themselves; raises unless they have exactly the rows of rows, once each, and no column that rows lack."""
    if extra := sorted(set(flags.columns) - set(rows.columns)):
        raise FlagsError(f"flags of unknown columns: {'||'.join(extra[:20])}")
    both = rows.select(row_id, F.lit(1).alias("r"), F.lit(0).alias("f")).unionByName(flags.select(row_id, F.lit(0).alias("r"), F.lit(1).alias("f")))
    if not both.groupBy(row_id).agg(F.sum("r").alias("r"), F.sum("f").alias("f")).where("r <> 1 OR f <> 1").isEmpty():
        raise FlagsError("flags and rows differ")
    return flags
