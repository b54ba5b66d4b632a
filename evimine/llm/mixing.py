"""Mixing sources to target weights.

Method: capped water-filling. Each source gets its weight's share of the total, is clamped at a maximum of epochs, and
what it cannot take is shared out again by weight among the others until none is above its cap. With sources in order
of cap per weight, that fixpoint is one water level, found with running sums over one row per source. A source's
target is then met by whole repetitions of all its documents plus one more of the first ones in a seeded order.

Only DataFrame functions. One aggregation per source (combined before the shuffle) and one per source and slice of
the seeded order; documents themselves are never sorted or collected per source: they meet one row of their source, which is broadcast if
the counted number of sources allows it, and else joined by the planner, which splits skewed sources. Only the documents of the one
slice in which a source's extra repetition ends are put in order, by ranges of it, as all rows of one id, or of none, lie in one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.llm._spark import cut
from evimine.operators import ranks

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the seeded order; sources up to which their table is broadcast (a few MB).
SLICES, FEW_SOURCES = 4096, 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sizes: one row per source with _source and source_size. Adds weight (1, 2, 3, repeating, by code point, null last) and target.

    Sources of equal cap per weight go in order of name; a source of size 0 has target 0; no sources, no rows. The windows
    put all sources in one task, so memory grows with their number, not with the documents'.
    """
    everywhere = W.orderBy(F.col("_source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(everywhere) - 1) % 3 + 1)
    weighed = weighed.withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    by_level = W.orderBy(F.col("_cap") / F.col("weight"), F.col("_source").asc_nulls_last())
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = F.when(left > 0, left / F.sum("weight").over(after)).otherwise(0.0)
    filled = weighed.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
    water = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("level")))).over(W.partitionBy())["level"]
    return filled.withColumn("target", F.least(F.col("_cap"), F.coalesce(water * F.col("weight"), F.col("_cap")))).drop("_cap", "_level", "_free")


def mix(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", seed: int = 17, max_epochs: int = 3) -> DataFrame:
    """docs with source_size, target and repeats (0 to max_epochs): how often the mix takes each row.

    size: a column with each row's words. docs is read four times, so give it a written table. Nulls make a source of
    their own, last in order; null sizes count 0; a row without words follows its source's repetitions. Repeated
    rows, and rows of one id or of none, are rows of their own: the cut goes between them, and rows that are equal in every column
    are taken in any order. An empty table stays empty. Columns named source_size, target or repeats are replaced; all others stay,
    whatever their names.
    """
    clean = docs.drop("source_size", "target", "repeats")
    words = F.coalesce(F.col(size), F.lit(0)).cast("long")
    keyed = clean.select(F.struct(*clean.columns).alias("row"), F.col(source).alias("source"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), words.alias("words"))
    # 60 bits of a digest, which any engine repeats
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id"))), 1, 15), 16, 10).cast("long")
    keyed = keyed.withColumn("place", place).withColumn("slice", F.shiftright("place", 20).bitwiseAND(F.lit(SLICES - 1)).cast("int"))

    slices = keyed.groupBy("source", "slice").agg(F.sum("words").alias("words"))
    sizes = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes.withColumnRenamed("source", "_source"), max_epochs).withColumnRenamed("_source", "source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.when(F.col("target").isNotNull(), 1))
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))

    # the slice in which the extra repetition ends, and what is left to take in it
    running = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cumulated = slices.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    at = cumulated.join(plan.select(F.col("source").alias("_s"), "extra"), F.col("source").eqNullSafe(F.col("_s")))
    at = at.where(F.col("before") <= F.col("extra")).groupBy("_s").agg(F.max("slice").alias("cut"), F.min(F.col("extra") - F.col("before")).alias("left"))
    per_source = plan.join(at, plan["source"].eqNullSafe(at["_s"]), "left").select(plan["source"].alias("_source"), "source_size", "target", "whole", "extra", "cut", "left")
    per_source = cut(per_source, "sources")
    if per_source.count() <= FEW_SOURCES:
        per_source = F.broadcast(per_source)
    joined = keyed.join(per_source, F.col("source").eqNullSafe(F.col("_source")), "left")

    hashed = [F.col("row")[name] for name, kind in clean.dtypes if "map<" not in kind and "variant" not in kind]  # those have no hash
    # in that slice, rows are counted off in order: equal ids, which a source may have by the million, by ranges too
    ends = (F.col("extra") > 0) & F.col("slice").eqNullSafe(F.col("cut"))
    columns = ["row", "source_size", "target", "whole", "extra", "slice", "cut"]
    inside = joined.where(ends).select(*columns, "left", "_source", "place", "id", "words", F.xxhash64(*hashed).alias("digest"), F.monotonically_increasing_id().alias("at"))
    order = [F.col(c).asc() for c in ("place", "id", "words", "digest", "at")]
    counted = ranks.running(inside, ["_source"], order, {"upto": ("sum", "words")})
    fits = (F.col("upto") - F.col("words") + F.col("words") / 2 <= F.col("left")).cast("long")
    outside = joined.where(~F.coalesce(ends, F.lit(False))).select(*columns)
    more = F.when((F.col("extra") > 0) & (F.col("slice") < F.col("cut")), 1).otherwise(0).cast("long")
    both = outside.select("row", "source_size", "target", (F.col("whole") + more).alias("repeats")).union(counted.select("row", "source_size", "target", (F.col("whole") + fits).alias("repeats")))
    return both.select("row.*", "source_size", "target", "repeats")


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as the mix takes it: none of a row with repeats 0 or null, and an empty table stays empty. Any names of columns."""
    taken = mixed.where("repeats > 0").select(F.struct(*columns).alias("row"), F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))
    return taken.select("row.*")


def oracle(seed: int = 17, max_epochs: int = 3) -> str:
    """The same mix of `documents` in SQL, with the words that it takes."""
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
k AS (SELECT *, (place >> 20) & {SLICES - 1} AS slice, coalesce(doc_id::VARCHAR, '') AS id FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, (source_size * {max_epochs})::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
v AS (SELECT *, CASE WHEN rest > 0 THEN rest / weights ELSE 0 END AS level FROM l),
water AS (SELECT arg_min(level, cap / weight) AS level FROM v WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM water) * weight, cap)) AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END::BIGINT AS whole FROM t),
e AS (SELECT *, greatest(0, target - whole * source_size) AS extra FROM p),
o AS (SELECT k.*, source_size, target, whole, extra,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY slice RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_slice,
    coalesce(sum(size) OVER (PARTITION BY k.source, slice ORDER BY place, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, max(slice) FILTER (WHERE before_slice <= extra) OVER (PARTITION BY source) AS cut FROM o)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN extra > 0 AND (slice < cut OR (slice = cut AND before + size / 2 <= extra - before_slice)) THEN 1 ELSE 0 END) AS taken FROM c"""
