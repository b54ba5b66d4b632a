"""Declarative boolean items: a manifest, fitted on training rows, compiled into columns.

Rows are reduced to bit patterns of the items they hit. Every rule statistic depends on a row only through its pattern,
so one scan with a combining aggregate gives at most 2**items rows per key, from which all rules are evaluated.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evimine.operators import quantiles

OPERATORS = (">", "<=", "==")


@dataclass(frozen=True)
class Item:
    """source OP threshold. unobserved: codes of source that mean nothing was observed, and then the item is false."""

    name: str
    source: str
    operator: str
    threshold: float | str
    family: str = "other"
    unobserved: tuple[float, ...] = ()
    threshold_source: str = "domain"

    @property
    def continuous(self) -> bool:
        return self.operator != "=="

    @property
    def clarity(self) -> float:
        return 0.7 if "exploratory" in self.threshold_source else 1.0

    def observed(self) -> Column:
        value = F.col(self.source)
        return value.isNotNull() & ~value.isin(*self.unobserved) if self.unobserved else value.isNotNull()

    def column(self, delta: float | Column = 0.0) -> Column:
        """Whether a row hits the item, with its threshold scaled by 1 + delta; false where nothing was observed."""
        value = F.col(self.source)
        moved = self.continuous and (isinstance(delta, Column) or delta != 0)
        edge = self.threshold * (1 + delta) if moved else self.threshold
        hit = {">": value > edge, "<=": value <= edge, "==": value == edge}[self.operator]
        return F.coalesce(self.observed() & hit, F.lit(False))


def fit_thresholds(train: DataFrame, items: list[Item]) -> list[Item]:
    """Items whose threshold is the text `median` get the exact training median of the observed values; the same few passes for all."""
    open_ = [i for i in items if i.threshold == "median"]
    if not open_:
        return items
    found = quantiles.medians(train, {str(n): F.when(i.observed(), F.col(i.source)) for n, i in enumerate(open_)})
    fitted = {i: Item(i.name, i.source, i.operator, found.get(str(n), 0.0), i.family, i.unobserved, "exploratory_train_median") for n, i in enumerate(open_)}
    return [fitted.get(i, i) for i in items]


def problems(items: list[Item], columns: list[str]) -> list[str]:
    """What is wrong with a manifest; empty if it may be used."""
    names = [i.name for i in items]
    found = [f"duplicate item {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    found += [f"{i.name}: unknown operator {i.operator}" for i in items if i.operator not in OPERATORS]
    found += [f"{i.name}: no column {i.source}" for i in items if i.source not in columns]
    found += [f"{i.name}: threshold is not a number" for i in items if i.continuous and not isinstance(i.threshold, int | float)]
    if len(items) > 62:
        found.append("more than 62 items in one pattern")
    return found


def pattern(items: list[Item], delta: float | Column = 0.0) -> Column:
    """Bit i is set if the row hits item i."""
    bits = (F.when(item.column(delta), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, item in enumerate(items))
    return reduce(lambda a, b: a + b, bits)


def hit_items(items: list[Item]) -> Column:
    """Names of the items that the row hits, for any number of items."""
    return F.array_compact(F.array(*(F.when(i.column(), F.lit(i.name)) for i in items)))


def patterns(rows: DataFrame, items: list[Item], label: str, by: tuple[str, ...] = (), delta: float = 0.0) -> DataFrame:
    """by, bits, n and y (rows, and those with label) of every pattern that occurs."""
    return rows.groupBy(*by, pattern(items, delta).alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("y"))


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows held in the plan as values, so that the planner knows their size."""
    return settled(spark.createDataFrame(rows, schema))


def settled(df: DataFrame) -> DataFrame:
    """df computed once and held in the plan as values. Only for tables bounded by the manifest, never by rows."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def rule_table(spark: SparkSession, items: list[Item], sizes: tuple[int, ...]) -> DataFrame:
    """All itemsets of the given sizes: items (sorted names), bits, families (sorted, distinct), n_items, clarity and continuous."""
    bit = {item.name: 1 << n for n, item in enumerate(items)}
    sets = [c for size in sizes for c in combinations(sorted(items, key=lambda i: i.name), size)]
    columns = {
        "items": pa.array([[i.name for i in c] for c in sets], pa.list_(pa.string())),
        "bits": pa.array([sum(bit[i.name] for i in c) for c in sets], pa.int64()),
        "families": pa.array([sorted({i.family for i in c}) for c in sets], pa.list_(pa.string())),
        "n_items": pa.array([len(c) for c in sets], pa.int32()),
        "clarity": pa.array([sum(i.clarity for i in c) / len(c) for c in sets], pa.float64()),
        "continuous": pa.array([max(int(i.continuous) for i in c) for c in sets], pa.int32()),
    }
    return spark.createDataFrame(pa.table(columns), "items array<string>, bits long, families array<string>, n_items int, clarity double, continuous int")


def covers(bits: Column, rule_bits: Column) -> Column:
    return bits.bitwiseAND(rule_bits) == rule_bits


def evaluate(seen: DataFrame, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rules with total, positives (of all rows per by), hit and hit_y.

    One pass over seen: a pattern visits every rule and is combined before the shuffle. Patterns are bounded by the number
    of items, and rules by the itemsets of the manifest, whose size the planner knows.
    """
    bits = rules.select(F.col("bits").alias("rule_bits")).distinct()
    hit = covers(F.col("bits"), F.col("rule_bits"))
    sums = (
        seen.crossJoin(bits)
        .groupBy(*by, "rule_bits")
        .agg(F.sum("n").alias("total"), F.sum("y").alias("positives"), F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("long").alias("hit"), F.sum(F.when(hit, F.col("y")).otherwise(0)).cast("long").alias("hit_y"))
    )
    return rules.join(sums, F.col("bits") == F.col("rule_bits"), "inner" if by else "left").select(*by, *rules.columns, "total", "positives", F.coalesce("hit", F.lit(0)).cast("long").alias("hit"), F.coalesce("hit_y", F.lit(0)).cast("long").alias("hit_y"))


def measures(evaluated: DataFrame) -> DataFrame:
    """support (joint), confidence, lift, leverage and conviction of each rule towards the label; no lift where no row has the label."""
    n = F.nullif(F.col("total").cast("double"), F.lit(0.0))
    base = F.col("positives") / n
    conf = F.col("hit_y") / F.nullif(F.col("hit"), F.lit(0))
    return evaluated.withColumns(
        {
            "support": F.col("hit_y") / n,
            "confidence": conf,
            "lift": conf / F.nullif(base, F.lit(0.0)),
            "leverage": F.col("hit_y") / n - F.col("hit") / n * base,
            "conviction": F.when(conf < 1, (1 - base) / (1 - conf)).otherwise(F.when(conf >= 1, F.lit(float("inf")))),
        }
    )
