"""Three-item rules end to end: admission, evidence, physical validity, eligibility and the tables that report them.

All tables here hold one row per rule and are bounded by the manifest; the work on rows is done before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimine.operators import evidence as E

# Families of which a triplet needs one, and what its flags say.
CORE_FAMILIES = ("speed_v0", "speed_vk", "age", "bio", "road_env", "road_type", "lane", "vehicle_size", "vehicle_state", "light", "road_surface", "weather", "safety", "crash_type")
PURE, PARTIAL = "pure_missing_unknown", "partial_unknown_detail"
ADDS, CONTEXT = "incremental_lift", "scene_context_only"
INVALID_TIER = "data-availability-or-redundancy-dominated replay signal"
SENSITIVE = "Statistically confirmed but threshold-sensitive; use as supplementary monitoring evidence rather than a primary governance rule."
USES = {
    E.CORE: "priority_governance_target",
    E.BINARY: "stable_categorical_governance_signal",
    E.STATISTICAL: "confirmatory_monitoring_signal",
    E.REPLAYABLE: "replayed_without_confirmatory_evidence",
    E.EXPLORATORY: "hypothesis_generation_only",
}


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def admitted(rules: DataFrame, manifest: DataFrame) -> DataFrame:
    """rules (antecedent, items) whose items are all in the manifest, none purely missing, of distinct meanings and sources, of two families or more, one of them core.

    manifest: item, family, semantic, source and missing.
    """
    each = rules.select("antecedent", F.explode("items").alias("item")).join(manifest, "item", "left")
    n = F.count(F.lit(1))
    found = each.groupBy("antecedent").agg(
        (F.count("family") == n).alias("_known"),
        (F.count_if(F.col("missing") == PURE) == 0).alias("_observed"),
        (F.count_distinct("semantic") == n).alias("_meanings"),
        (F.count_distinct("source") == n).alias("_sources"),
        (F.count_distinct("family") >= 2).alias("_families"),
        (F.count_if(F.col("family").isin(*CORE_FAMILIES)) > 0).alias("_core"),
    )
    passes = reduce(lambda a, b: a & b, (F.col(c) for c in found.columns if c != "antecedent"))
    return rules.join(found.where(passes).select("antecedent"), "antecedent", "left_semi")


def without_items(rules: DataFrame, items: list[str]) -> DataFrame:
    """rules that hold none of the items."""
    return rules.where(~F.arrays_overlap("items", F.array(*map(F.lit, items)).cast("array<string>"))) if items else rules


def value_flag(lift: Column, best_parent: Column) -> Column:
    """Whether a rule adds lift over the best of its pairs."""
    return F.when(lift - best_parent > 0, ADDS).otherwise(CONTEXT)


def graded(replayed: DataFrame, boot: DataFrame, moved: DataFrame, key: str = "antecedent") -> DataFrame:
    """replayed rules joined with their recurrence and sensitivity, graded, with the flags that the grade rests on."""
    rows = replayed.join(boot.select(key, "recurrence"), key, "left").join(moved.select(key, "hit_min", "lift_min"), key, "left")
    tier = E.tier(require_hit_stability=True)
    cont = F.col("continuous") == 1
    rows = rows.withColumns(
        {
            "tier": tier,
            "fixed_hit_ok": _flag(F.col("hit") >= E.CORE_HITS),
            "threshold_hit_ok": _flag(~cont | (F.col("hit_min") >= E.CORE_HITS)),
            "threshold_lift_ok": _flag(~cont | (F.col("lift_min") >= E.LIFT)),
        }
    )
    use = F.create_map(*(F.lit(x) for kv in USES.items() for x in kv))
    return rows.withColumns({"threshold_stable": F.col("threshold_hit_ok") * F.col("threshold_lift_ok"), "use": use[F.col("tier")]})


def with_validity(rows: DataFrame, items: DataFrame) -> DataFrame:
    """graded rules with the flags of their items, physical validity and tier, and what each may be reported in.

    items: item, unobserved_share (of its test hits), missing, semantic and physical (1 if a mechanism can be read from
    it). An item that is not there counts as observed, valid and of no meaning.
    """
    each = rows.select("antecedent", F.explode("items").alias("item")).join(items, "item", "left")
    by = each.groupBy("antecedent").agg(
        F.coalesce(F.max("unobserved_share"), F.lit(0.0)).alias("max_unobserved"),
        _flag(F.max(F.col("missing") == PURE)).alias("pure_missing"),
        _flag(F.max(F.col("missing") == PARTIAL)).alias("partial_unknown"),
        _flag(F.count("semantic") != F.count_distinct("semantic")).alias("semantic_duplicate"),
        _flag(F.min(F.coalesce("physical", F.lit(1))) == 1).alias("_physical"),
    )
    out = rows.join(by, "antecedent", "left")
    dominated = F.coalesce("max_unobserved", F.lit(0.0)) >= 0.5
    valid = ~dominated & (F.col("pure_missing") + F.col("partial_unknown") + F.col("semantic_duplicate") == 0) & (F.col("_physical") == 1)
    out = out.withColumns({"dominated": _flag(dominated), "physical_valid": _flag(valid)}).drop("_physical")
    good = F.col("physical_valid") == 1
    out = out.withColumns(
        {
            "physical_tier": F.when(good, F.col("tier")).otherwise(INVALID_TIER),
            "manuscript": _flag(F.col("tier").isin(E.CORE, E.BINARY, E.STATISTICAL) & good),
            "main_text": _flag(F.col("tier").isin(E.CORE, E.BINARY) & good & (F.col("threshold_stable") == 1)),
        }
    )
    return out.withColumn("supplementary", _flag((F.col("main_text") == 0) | F.col("tier").isin(E.STATISTICAL, E.REPLAYABLE, E.EXPLORATORY)))


def main_table(rows: DataFrame) -> DataFrame:
    """Rules that the main text may report: core first, then risk ratio and hits, ties by rule_id."""
    order = [E.tier_rank(F.col("tier")), F.desc_nulls_last("risk_ratio"), F.desc_nulls_last("hit"), F.asc("rule_id")]
    return rows.where("main_text = 1").orderBy(*order)


def interpretation(rows: DataFrame, template: Column) -> DataFrame:
    """rows with the sentence that may be said of each; threshold-sensitive ones get their own."""
    sensitive = (F.col("tier") == E.STATISTICAL) & (F.col("threshold_stable") == 0)
    return rows.withColumn("interpretation", F.when(sensitive, SENSITIVE).otherwise(template))


def output_checks(rows: DataFrame) -> DataFrame:
    """name and status of what must hold of the rules that are reported; no rules, no failure."""
    bad = {
        "no purely missing item in a reported rule": (F.col("manuscript") == 1) & (F.col("pure_missing") == 1),
        "no repeated meaning in a reported rule": (F.col("manuscript") == 1) & (F.col("semantic_duplicate") == 1),
        "no item dominated by unknown values in a reported rule": (F.col("manuscript") == 1) & (F.col("dominated") == 1),
        "main text holds valid confirmed rules only": (F.col("main_text") == 1) & ~((F.col("physical_valid") == 1) & F.col("tier").isin(E.CORE, E.BINARY)),
    }
    counts = rows.agg(*(F.count_if(c).alias(str(i)) for i, c in enumerate(bad.values())))
    status = lambda i: F.when(F.col(str(i)) == 0, "PASS").otherwise("FAIL")
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), status(i).alias("status"), F.col(str(i)).alias("n_bad")) for i, n in enumerate(bad)))))


def released(rows: DataFrame) -> DataFrame:
    """rows as they may be reported: if any check fails, none is eligible and all are supplementary."""
    failed = output_checks(rows).agg(F.max(F.col("status") == "FAIL").alias("_failed"))
    out = rows.crossJoin(F.broadcast(failed))  # one row
    return out.withColumns(
        {
            "manuscript": F.when(F.col("_failed"), 0).otherwise(F.col("manuscript")),
            "main_text": F.when(F.col("_failed"), 0).otherwise(F.col("main_text")),
            "supplementary": F.when(F.col("_failed"), 1).otherwise(F.col("supplementary")),
        }
    ).drop("_failed")
