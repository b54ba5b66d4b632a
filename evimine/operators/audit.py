"""Checks as rows, lineage of fits, and usage of unknown values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, required: str, holds: Column) -> DataFrame:
    """One row: whether an aggregate of df holds."""
    ok = F.coalesce(holds, F.lit(False))
    return df.agg(ok.alias("ok")).select(F.lit(name).alias("name"), F.lit(required).alias("required"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"))


def checks(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class ChecksFailed(ValueError):
    """Some check row is FAIL."""


def require(found: DataFrame) -> DataFrame:
    failed = [r["name"] for r in found.where("status = 'FAIL'").limit(20).collect()]
    if failed:
        raise ChecksFailed(", ".join(failed))
    return found


def widened(parts: list[DataFrame]) -> DataFrame:
    """All rows; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def item_replay(rows: DataFrame, items, by: str = "split") -> DataFrame:
    """Per item and split: rows, hits, hits on unobserved values and their share, the source's range, and a status. One scan."""
    each = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(i.name).alias("item"),
                    i.column().alias("hit"),
                    (~i.observed()).alias("unobserved"),
                    (F.col(i.source).cast("double") if i.continuous else F.lit(None).cast("double")).alias("value"),
                )
                for i in items
            )
        )
    )
    long = rows.select(by, each.alias("i")).select(by, "i.*")
    n = long.groupBy("item", by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("hit").alias("n_hits"),
        F.count_if(F.col("hit") & F.col("unobserved")).alias("n_unobserved_hits"),
        F.count_if("unobserved").alias("n_unobserved"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    share = F.coalesce(F.col("n_unobserved_hits") / F.nullif(F.col("n_hits"), F.lit(0)), F.lit(0.0))
    status = F.when(F.col("n_hits") == 0, "never hit").when(share >= 0.5, "dominated").when(share >= 0.2, "warning").otherwise("ok")
    return n.withColumns({"hit_rate": F.col("n_hits") / F.col("n_rows"), "unobserved_share": share, "status": status})


def usage(features: DataFrame, used: dict[str, DataFrame], feature: str = "feature") -> DataFrame:
    """features with a 0/1 column per named use."""
    out = features
    for name, table in used.items():
        marks = table.select(feature).distinct().withColumn(name, F.lit(1))
        out = out.join(marks, feature, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def semantic_duplicates(rules: DataFrame, meaning: DataFrame) -> DataFrame:
    """One row per rule (antecedent, items) and group of meaning (item, semantic) with two or more of its items."""
    each = rules.select("antecedent", F.explode("items").alias("item")).join(F.broadcast(meaning), "item")
    return each.groupBy("antecedent", "semantic").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), "||").alias("duplicated")).where("n_items > 1")


#: Stages and whether each may learn from test rows.
STAGES = {"cohort": False, "split": False, "matrix": False, "selection": False, "mining": False, "replay": True, "grading": True, "models": False, "triplets": False}


def leakage_matrix(spark, used: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """stage, input, split and status of every input that a stage recorded: a test input is FAIL unless the stage only evaluates."""
    rows = [(stage, name, split, "PASS" if split == "train" or STAGES.get(stage, False) else "FAIL") for stage, inputs in used.items() for name, split in inputs]
    return spark.createDataFrame(rows, "stage string, input string, split string, status string")


# What a written file belongs to, by the beginning of its name; the first match wins.
FILE_CATEGORIES = (
    ("core_cohort_preprocessing", ("Train_Test", "Preprocess", "Derived", "PostProcess", "Matrix_", "Sentinel_", "Engineering_", "Categorical_")),
    ("feature_selection", ("Feature_Screener", "Feature_Consensus", "Final_Consensus", "Feature_Family", "Feature_Semantic")),
    ("primary_rule_mining_replay", ("04_Rule", "Final_Rules", "Rule_", "06C_", "06D_", "06F_", "Governance_", "Main_Text_Rule", "Main_vs_", "Final_Blind_Test_Validation_Report.csv")),
    ("model_baseline", ("09",)),
    ("leakage_verification", ("Leakage", "Test_Sanctity", "Final_Verification")),
    ("triplet_extension", ("Triplet", "Main_Text_Triplet")),
    ("feature_space_sensitivity", ("Feature_Space_Size",)),
)


def file_category(name: Column) -> Column:
    """What a written file belongs to; manifests that belong to nothing else are `manifest`, the rest `other`."""
    chain = F.when(F.lit(False), "")
    for label, starts in FILE_CATEGORIES:
        chain = chain.when(reduce(lambda a, b: a | b, (name.startswith(p) for p in starts)), label)
    return chain.when(name.endswith("_Manifest.json"), "manifest").otherwise("other")


def cleanup_reason(name: Column, final: list[str], obsolete: list[str], archive: str, patterns: list[str]) -> Column:
    """Why a file in the working folder may go: its list, an archive, a manifest, or a pattern (with `*`) of generated files; else `unknown`."""
    generated = reduce(lambda a, b: a | b, (name.like(p.replace("_", "\\_").replace("*", "%")) for p in patterns), F.lit(False))
    return (
        F.when(name.isin(*obsolete), "obsolete_output")
        .when(name.isin(*final), "previous_final_package_file")
        .when(name.endswith(".zip") & (name != archive), "old_zip")
        .when(name == archive, "previous_final_zip")
        .when(name.endswith("_Manifest.json"), "stale_manifest")
        .when(generated, "stale_generated_output")
        .otherwise("unknown")
    )


def generated_files(files: DataFrame, kept: list[str], final: list[str], obsolete: list[str], archive: str, patterns: list[str]) -> DataFrame:
    """files (name) that a run may remove, with the reason; never those in kept (sources and inputs)."""
    known = files.where(~F.col("name").isin(*kept)) if kept else files
    return known.withColumn("reason", cleanup_reason(F.col("name"), final, obsolete, archive, patterns)).where("reason <> 'unknown'")


def alias_co_occurrence(rules: DataFrame, aliases: list[str], items: str = "items") -> DataFrame:
    """rules that hold two or more names of one thing."""
    return rules.where(F.size(F.array_intersect(items, F.array(*map(F.lit, aliases)))) > 1)


def schema_problems(df: DataFrame, required: dict[str, str]) -> list[str]:
    """Missing columns and those of another type."""
    have = dict(df.dtypes)
    return [f"{c}: missing" if c not in have else f"{c}: {have[c]} instead of {t}" for c, t in required.items() if have.get(c) != t]


def require_columns(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    """df itself; raises with the columns that it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ChecksFailed(f"{name} lacks {', '.join(missing)}")
    return df


def require_known_items(items: DataFrame, item: str = "item", kind: str = "missing") -> DataFrame:
    """items themselves; raises with the first twenty that say nothing but that a value is missing, as rules must not be replayed on those."""
    require_columns(items, [item, kind], "items")
    found = items.where(F.col(kind) == "pure_missing_unknown").select(item).distinct().orderBy(item).limit(20).collect()
    if found:
        raise ChecksFailed("items that only say missing: " + "||".join(str(r[0]) for r in found))
    return items


def table_membership(graded: DataFrame, table: DataFrame, key: str, tiers: tuple[str, ...]) -> DataFrame:
    """One row: whether table holds the keys of the graded rules (key, tier) of these tiers and no others, with the numbers of both, of missing and of excess keys. Null keys are keys."""
    expected = graded.where(F.col("tier").isin(*tiers)).select(key, F.lit(1).alias("want"), F.lit(0).alias("have"))
    both = expected.unionByName(table.select(key, F.lit(0).alias("want"), F.lit(1).alias("have"))).groupBy(key).agg(F.max("want").alias("want"), F.max("have").alias("have"))
    missing, excess = F.count_if(F.col("want") > F.col("have")), F.count_if(F.col("have") > F.col("want"))
    counted = both.agg(F.count_if(F.col("want") == 1).alias("n_expected"), F.count_if(F.col("have") == 1).alias("n_present"), missing.alias("n_missing"), excess.alias("n_excess"))
    return counted.withColumn("status", F.when(F.col("n_missing") + F.col("n_excess") == 0, "PASS").otherwise("FAIL"))


def require_membership(graded: DataFrame, table: DataFrame, key: str, tiers: tuple[str, ...]) -> DataFrame:
    """table itself; raises unless it holds exactly the graded rules of these tiers."""
    found = table_membership(graded, table, key, tiers).first()
    if found["status"] != "PASS":
        raise ChecksFailed(f"{found['n_missing']} rules missing, {found['n_excess']} too many")
    return table


def same_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: distinct keys that only a has, that only b has, and whether the two sets are equal. Null keys are keys."""
    both = a.select(*columns, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*columns, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy(*columns).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = each.agg(F.count_if(F.col("b") == 0).alias("n_only_a"), F.count_if(F.col("a") == 0).alias("n_only_b"))
    return out.withColumn("equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))


#: What a manifest must say of total vehicle mass.
MASS_NAMES, MASS, NOT_MASS_AXES = ("GEWGES", "碰撞时的总重"), "vehicle_mass", ("crash_configuration", "vehicle_geometry_interaction")


def mass_violations(manifest: DataFrame) -> DataFrame:
    """Manifest rows (source, family, semantic, axis) of total vehicle mass that are labelled as something else, with the reasons."""
    of_mass = F.col("source").rlike("|".join(MASS_NAMES))
    wrong = lambda c: F.coalesce(F.col(c), F.lit("")) != MASS
    reasons = F.concat_ws("|", F.when(wrong("family"), "family!=vehicle_mass"), F.when(wrong("semantic"), "Semantic_Group!=vehicle_mass"), F.when(F.col("axis").isin(*NOT_MASS_AXES), "Mechanism_Axis_forbidden"))
    return manifest.where(of_mass).withColumn("violation", reasons).where("violation <> ''")


def require_manifest(items: list, columns: list[str]) -> list:
    """items themselves; raises with everything that is wrong with them."""
    from evimine.operators.items import problems

    if found := problems(items, columns):
        raise ChecksFailed("; ".join(found))
    return items


def candidate_audit(candidates: dict[str, DataFrame], replayed: dict[str, DataFrame]) -> DataFrame:
    """Per method: its candidates and how many of them were replayed."""
    parts = [c.agg(F.count(F.lit(1)).alias("n_candidates")).withColumn("method", F.lit(m)) for m, c in candidates.items()]
    tests = [r.agg(F.count(F.lit(1)).alias("n_replayed")).withColumn("method", F.lit(m)) for m, r in replayed.items()]
    return reduce(DataFrame.unionByName, parts).join(reduce(DataFrame.unionByName, tests), "method")


def package_checks(ready: bool, excluded: bool, files: list[str], present: list[str], main_rows: int | None) -> list[tuple[str, str]]:
    """name and status of what a package must hold: all files of an extension that is ready; of one that is not, an empty main table, or none and a note that it is left out."""
    if ready:
        missing = [f for f in files if f not in present]
        return [("files of a ready extension exist", "FAIL: " + "||".join(missing) if missing else "PASS")]
    if main_rows is not None:
        return [("main table of an extension that is not ready is empty", "PASS" if main_rows == 0 else "FAIL")]
    return [("absence of the main table is noted", "PASS" if excluded else "FAIL")]
