"""Grading rules: group bootstrap, threshold sensitivity, evidence tiers, physical validity and roll-ups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimine.operators import items as I
from evimine.sources.scratch import ship

# Tier names and limits.
CORE, BINARY, STATISTICAL, REPLAYABLE, EXPLORATORY = "core-confirmed", "binary-stable confirmed", "statistically confirmed", "replayable", "exploratory"
TIER_ORDER = (CORE, BINARY, STATISTICAL, REPLAYABLE, EXPLORATORY)
DELTAS = (-0.20, -0.10, 0.0, 0.10, 0.20)
ITERATIONS, MIN_SUPPORT, SUPPORT_SHARE = 200, 0.015, 0.8
Q, RECURRENCE, RISK, LIFT, CORE_HITS, REPLAY_HITS = 0.05, 0.95, 1.0, 1.0, 5, 1
#: Cumulative probabilities of the Poisson distribution with mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
#: A prime modulus of the draws, and the fewest rows of a replicate.
DRAW_MODULUS, LEAST_ROWS = 2**31 - 1, 20
#: Patterns whose sums a task of the bootstrap holds before it tells them (some kB each).
PATTERNS_HELD = 4096


def draw_seeds(group: Column) -> tuple[Column, Column]:
    """Two numbers below 2**32 from the digest of a group's id as text; null is a group of its own."""
    digest = F.md5(F.coalesce(group.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def multiplicity(first: Column, second: Column, iteration: Column) -> Column:
    """How often a group with these seeds is drawn in an iteration: Poisson with mean 1, groups independent of each other and iterations pairwise so."""
    u = F.pmod(first + iteration.cast("long") * second, F.lit(DRAW_MODULUS)) / float(DRAW_MODULUS)
    return reduce(lambda total, p: total + F.when(u >= p, 1).otherwise(0), POISSON, F.lit(0))


def _weighted(batches: Iterator[pa.RecordBatch], iterations: int) -> Iterator[pa.RecordBatch]:
    """Rows (bits, y, digest of the group) as iteration, bits, n and y: how many rows of a pattern an iteration draws, and those with label.

    The multiplicity of a group, computed for a batch at a time: seeds modulo the modulus stay below 2**32 when one is added to another.
    """
    edges = [next(v for v in range(int(p * DRAW_MODULUS) - 2, DRAW_MODULUS + 1) if v / float(DRAW_MODULUS) >= p) for p in POISSON]
    sums: dict[int, np.ndarray] = {}

    def told() -> pa.RecordBatch:
        found = np.concatenate([s[:, s[0] > 0] for s in sums.values()], axis=1)
        bits = np.repeat(np.array(list(sums), np.int64), [int((s[0] > 0).sum()) for s in sums.values()])
        at = np.concatenate([np.flatnonzero(s[0] > 0) for s in sums.values()]).astype(np.int32)
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits), pa.array(found[0]), pa.array(found[1])], names=["iteration", "bits", "n", "y"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bits, y = batch.column("bits").to_numpy(), batch.column("y").to_numpy()
        seeds = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u4").reshape(-1, 4)[:, :2]
        # rows of a group often follow each other and are drawn once
        fresh = np.concatenate([[True], (seeds[1:] != seeds[:-1]).any(axis=1)])
        first, second = ((seeds[fresh, i].astype(np.int64) % DRAW_MODULUS).astype(np.uint32) for i in (0, 1))
        order = np.argsort(bits, kind="stable")
        group, y = (np.cumsum(fresh) - 1)[order], y[order]
        names, starts = np.unique(bits[order], return_index=True)
        out = np.empty((2, iterations, len(names)), np.int64)
        modulus = np.uint32(DRAW_MODULUS)
        for i in range(iterations):
            times = sum((first >= np.uint32(e)).view(np.int8) for e in edges)[group].astype(np.int64)
            out[0, i], out[1, i] = np.add.reduceat(times, starts), np.add.reduceat(times * y, starts)
            first = first + second
            first = np.minimum(first, first - modulus)  # below the modulus the difference wraps around and is the greater
        for n, name in enumerate(names.tolist()):
            sums[name] = sums[name] + out[:, :, n] if name in sums else out[:, :, n].copy()
        if len(sums) > PATTERNS_HELD:
            yield told()
    if sums:
        yield told()


def bootstrap(train: DataFrame, items: list[I.Item], label: str, group: str, rules: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """rules with recurrent (replicates in which the antecedent's support and the lift hold) and recurrence, of those with at least LEAST_ROWS rows.

    Groups of any type of id are weighted independently, so no draw needs the number of groups, and a row is weighted where it is read: no
    table of groups is made or moved. A task adds the weights up by pattern; iterations x patterns rows leave it.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(group).cast("string"), F.lit(""))))
    rows = train.select(I.pattern(items).alias("bits"), F.coalesce(F.col(label).cast("long"), F.lit(0).cast("long")).alias("y"), digest.alias("digest"))
    ship(train.sparkSession)
    drawn = rows.mapInArrow(lambda batches: _weighted(batches, iterations), "iteration int, bits long, n long, y long")
    sums = drawn.groupBy("iteration", "bits").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    found = I.measures(I.evaluate(sums, rules.select("bits"), by=("iteration",))).where(F.col("total") >= LEAST_ROWS)
    holds = F.coalesce((F.col("hit") / F.col("total") >= SUPPORT_SHARE * MIN_SUPPORT) & (F.col("lift") >= LIFT), F.lit(False))
    counts = found.groupBy("bits").agg(F.count_if(holds).alias("recurrent"), (F.count_if(holds) / F.count(F.lit(1))).alias("recurrence"))
    none = {"recurrent": F.coalesce("recurrent", F.lit(0).cast("long")), "recurrence": F.coalesce("recurrence", F.lit(0.0))}
    return rules.join(I.settled(counts), "bits", "left").withColumns(none)


def moved_patterns(test: DataFrame, items: list[I.Item], label: str, deltas: tuple[float, ...] = DELTAS) -> DataFrame:
    """delta (place in deltas), bits, n and y of the patterns that rows have as thresholds move; one scan."""
    # the shift is a column: the patterns of all shifts in one expression are more code than the JVM compiles
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("delta"), F.lit(float(d)).alias("shift")) for i, d in enumerate(deltas))))
    own = dict.fromkeys(i.source for i in items)
    each = test.select(F.col(label).alias("_y"), *own, at.alias("_at")).select(F.col("_y").alias("y"), F.col("_at.delta").alias("delta"), I.pattern(items, F.col("_at.shift")).alias("bits"))
    return each.groupBy("delta", "bits").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("y"))


def sensitivity_of(moved: DataFrame, rules: DataFrame) -> DataFrame:
    """rules with the least hits and the range of lifts over moved patterns; null for rules without a threshold."""
    found = I.measures(I.evaluate(moved, rules.where("continuous = 1").select("bits"), by=("delta",)))
    least = found.groupBy("bits").agg(F.min("hit").alias("hit_min"), F.min("lift").alias("lift_min"), F.max("lift").alias("lift_max"), F.min("confidence").alias("confidence_min"))
    return rules.join(I.settled(least), "bits", "left")


def sensitivity(test: DataFrame, items: list[I.Item], label: str, rules: DataFrame, deltas: tuple[float, ...] = DELTAS) -> DataFrame:
    """sensitivity_of the patterns of test."""
    return sensitivity_of(moved_patterns(test, items, label, deltas), rules)


def tier(require_hit_stability: bool = False) -> Column:
    """The evidence ladder over resolved, hit, q_value, risk_ratio, recurrence, continuous, lift_min and hit_min; null compares false."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    resolved = ok(F.col("resolved"))
    stat = resolved & ok((F.col("hit") >= REPLAY_HITS) & (F.col("q_value") <= Q) & (F.col("risk_ratio") >= RISK))
    boot = ok(F.col("recurrence") >= RECURRENCE)
    often = ok(F.col("hit") >= CORE_HITS)
    stable = ok(F.col("lift_min") >= LIFT)
    if require_hit_stability:
        stable = stable & ok(F.col("hit_min") >= CORE_HITS)
    cont = F.col("continuous") == 1
    return F.when(stat & boot & often & cont & stable, CORE).when(stat & boot & often & ~cont, BINARY).when(stat, STATISTICAL).when(resolved, REPLAYABLE).otherwise(EXPLORATORY)


def physical_tier(evidence: Column, valid: Column, only_confirmed: bool = True) -> Column:
    """The tier, downgraded for rules that missing values or redundancy may explain."""
    concerned = evidence.isin(CORE, BINARY) if only_confirmed else F.lit(True)
    return F.when(concerned & ~valid, F.concat(F.lit("data-availability-or-redundancy "), evidence)).otherwise(evidence)


def threshold_stable() -> Column:
    return F.coalesce((F.col("continuous") == 1) & (F.col("lift_min") >= LIFT) & (F.col("hit_min") >= CORE_HITS), F.lit(False)).cast("int")


def tier_rank(evidence: Column) -> Column:
    return reduce(lambda c, t: c.when(evidence == t[1], t[0]), enumerate(TIER_ORDER), F.when(F.lit(False), 0)).otherwise(len(TIER_ORDER))


def axis_summary(graded: DataFrame, axis: str = "axis") -> DataFrame:
    return graded.groupBy(axis).agg(
        F.count(F.lit(1)).alias("n_rules"),
        *(F.count_if(F.col("tier") == t).alias(n) for n, t in (("n_core", CORE), ("n_binary", BINARY), ("n_statistical", STATISTICAL), ("n_replayable", REPLAYABLE))),
        F.median("risk_ratio").alias("median_risk_ratio"),
        F.max("risk_ratio").alias("best_risk_ratio"),
    )


def spine(axes: DataFrame, tables: dict[str, DataFrame], axis: str = "axis") -> DataFrame:
    """Every axis, with the number of rows that each table has of it."""
    out = axes.select(axis).distinct()
    for name, t in tables.items():
        out = out.join(t.groupBy(axis).agg(F.count(F.lit(1)).alias(name)), axis, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def roll_up(graded: DataFrame, domain: Column) -> DataFrame:
    """Per domain: rules, the best tier, and rule names in order."""
    each = graded.withColumns({"domain": domain, "_rank": tier_rank(F.col("tier"))})
    return each.groupBy("domain").agg(F.count(F.lit(1)).alias("n_rules"), F.min_by("tier", "_rank").alias("best_tier"), F.array_join(F.array_sort(F.collect_list("antecedent")), "; ").alias("rules"))


def family_distribution(rules: DataFrame, by: list[str]) -> DataFrame:
    """`family:n` of all rules of a key, in order, joined by ||."""
    n = rules.select(*by, F.explode("families").alias("family")).groupBy(*by, "family").agg(F.count(F.lit(1)).alias("n"))
    each = F.concat("family", F.lit(":"), F.col("n").cast("string"))
    return n.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(each)), "||").alias("distribution"), F.count(F.lit(1)).alias("n_families"))


def reporting_role(evidence: Column) -> Column:
    return F.when(evidence.isin(CORE, BINARY), "main text").when(evidence == STATISTICAL, "monitoring").when(evidence == REPLAYABLE, "supplement").otherwise("hypothesis")


def main_table(graded: DataFrame, tiers: tuple[str, ...] = (CORE, BINARY, REPLAYABLE)) -> DataFrame:
    """The rules that a main table reports, best tier first, then risk ratio and hits, ties by name."""
    order = [tier_rank(F.col("tier")), F.desc_nulls_last("risk_ratio"), F.desc_nulls_last("hit"), F.asc("antecedent")]
    return graded.where(F.col("tier").isin(*tiers)).orderBy(*order)


def item_usage(graded: DataFrame, items: DataFrame) -> DataFrame:
    """items (item) with the number of graded rules that hold each, in all and per tier that confirms."""
    each = graded.select(F.explode("items").alias("item"), "tier")
    used = each.groupBy("item").agg(F.count(F.lit(1)).alias("n_rules"), *(F.count_if(F.col("tier") == t).alias(n) for n, t in (("n_core", CORE), ("n_binary", BINARY), ("n_statistical", STATISTICAL))))
    joined = items.join(used, "item", "left")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_rules", "n_core", "n_binary", "n_statistical")}
    return joined.withColumns(counts).withColumn("used_in_core", (F.col("n_core") + F.col("n_binary") > 0).cast("int"))


def recommended_use(evidence: Column) -> Column:
    return F.when(evidence == CORE, "priority governance target").when(evidence == BINARY, "targeted governance signal").when(evidence == STATISTICAL, "confirmatory monitoring signal").when(evidence == REPLAYABLE, "replay reference").otherwise("exploration only")


# What a rule or domain with this highest tier is called, and where it may be reported.
STRENGTH = {CORE: "priority governance target", BINARY: "stable categorical governance target", STATISTICAL: "audit-level governance cue", REPLAYABLE: "audit-level governance cue", EXPLORATORY: "hypothesis-generating governance cue"}
NO_STRENGTH = "mechanism covered but not supported by current replay evidence"
PLACE = {
    CORE: "can enter main result discussion",
    BINARY: "can enter main result discussion",
    STATISTICAL: "replayable: only as auditable governance cue",
    REPLAYABLE: "replayable: only as auditable governance cue",
    EXPLORATORY: "exploratory: supplementary hypothesis only",
}
NO_PLACE = "no evidence: mechanism coverage only, not a result finding"


def strength_label(highest: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in STRENGTH.items() for x in kv))[highest], F.lit(NO_STRENGTH))


def manuscript_place(highest: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in PLACE.items() for x in kv))[highest], F.lit(NO_PLACE))


def coverage_role(n_core: Column, n_binary: Column, n_replayable: Column, n_exploratory: Column, n_universe: Column) -> Column:
    """What an axis contributes, from the numbers of its rules."""
    return (
        F.when(n_core + n_binary > 0, "confirmed primary evidence")
        .when(n_replayable > 0, "replayable governance cue")
        .when(n_exploratory > 0, "hypothesis-generating only")
        .when(n_universe > 0, "present in train-mined universe but not confirmed")
        .otherwise("not observed under current train-only candidate criteria")
    )


def complexity_class(n_missing_families: Column, n_triplets: Column, herfindahl: Column, n_selected: Column, balance: int = 25) -> Column:
    return (
        F.when(n_missing_families > 0, "undercovered_mechanism_space")
        .when((n_triplets > 5000) | (herfindahl > 0.45), "higher_rule_complexity_or_axis_concentration")
        .when(n_selected == balance, "primary_balance_point")
        .otherwise("sensitivity_comparator_only")
    )
