"""Scoring a stream against a frozen manifest: the same compiled items, on unbounded rows.

State is bounded by the watermark: counts of a window are dropped once it is past.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimine.operators.items import Item, covers, pattern


def tagged(rows: DataFrame, items: list[Item]) -> DataFrame:
    """rows with the bits of the items they hit."""
    return rows.withColumn("bits", pattern(items))


def rule_counts(rows: DataFrame, items: list[Item], rules: list[tuple[str, int]], at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Hits of each rule (name, bits) per time window; late rows count until the watermark passes."""
    seen = tagged(rows, items).withWatermark(at, late)
    each = F.explode(F.filter(F.array(*(F.when(covers(F.col("bits"), F.lit(b).cast("long")), F.lit(n)) for n, b in rules)), lambda r: r.isNotNull()))
    counts = seen.select(at, each.alias("rule")).groupBy(F.window(at, window).alias("w"), "rule").agg(F.count(F.lit(1)).alias("hits"))
    return counts.select(F.col("w.start").alias("start"), "rule", "hits")
