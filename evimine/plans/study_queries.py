"""Queries over three-item evidence, name labels, flags, formats and checks, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.functions import taxonomy, text
from evimine.operators import audit, evidence, prep, profile, rules, screening, triplets
from evimine.operators import items as I
from evimine.plans import rule_queries as R
from evimine.plans import table_queries
from evimine.plans.facts import FACTS_SQL, ITEMS, evaluated_sql, facts, read, replay_sql
from evimine.sources.scratch import stored

WITH = f"WITH {FACTS_SQL}"


# Labels of names


def _words(pattern: str) -> str:
    """A word that a word pattern matches."""
    return re.sub(r"\?", "", re.sub(r"\[(.)[^\]]*\]", r"\1", pattern))


def label_names() -> list[str]:
    """Names that meet every decision, alone, within a longer name, and next to one that comes before it."""
    found = {"", "plain_name_here", "a_b_c_d", "VEHUSAGE_AGE", "V0_VKREG", "VKREG", "ALTER1", "x(ALTER1)", "FEATURE_AGE_YEARS", "有x具体未知", "具体未知"}
    for d in (*taxonomy.FAMILY, *taxonomy.MISSING, *taxonomy.SOURCE, *taxonomy.SEMANTIC, *taxonomy.THRESHOLD):
        for w in (*map(_words, d.words), *d.parts, *d.letters, *d.texts):
            found |= {w, f"VEH_{w}_1", f"x{w.lower()}y"}
    return sorted(found)


def name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of a name per part: one that meets a decision, every third with the part's type behind it."""
    known = F.array(*map(F.lit, label_names()))
    at = F.get(known, (F.col("p_partkey") % len(label_names())).cast("int"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(at, F.lit("_"), F.coalesce("p_type", F.lit("")))).otherwise(at)
    names = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    n = F.col("name")
    labels = {
        "family": taxonomy.family(n),
        "missing": taxonomy.missing_category(n),
        "source": taxonomy.source_group(n),
        "semantic": taxonomy.semantic_group(n),
        "threshold": taxonomy.threshold_source(n),
        "raw_age": taxonomy.is_raw_age(n),
        "age_related": taxonomy.is_age_related(n),
    }
    return names.select("p_partkey", "name", *(c.alias(k) for k, c in labels.items()))


def _decision_sql(d: taxonomy.Decision) -> str:
    tests = [f"regexp_matches(compact, '(^|_)({'|'.join(d.words)})(_|$)')"] if d.words else []
    for form, found in (("compact", d.parts), ("capitals", d.letters), ("name", d.texts)):
        tests += [f"regexp_matches({form}, '{'|'.join(map(re.escape, found))}')"] if found else []
    return f"(({' OR '.join(tests)}){f' AND NOT contains(capitals, {d.unless!r})' if d.unless else ''})"


def _classify_sql(decisions: tuple[taxonomy.Decision, ...], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {_decision_sql(d)} THEN '{d.label}'" for d in decisions) + f" ELSE {otherwise} END"


_PARTS = "list_filter(string_split(name, '_'), lambda p: p <> '')"
_REST = f"CASE WHEN len({_PARTS}) >= 3 THEN array_to_string(list_slice({_PARTS}, 1, greatest(1, len({_PARTS}) - 1)), '_') ELSE name END"
NAME_LABELS = f"""WITH n AS (SELECT name, upper(name) AS capitals, regexp_replace(upper(name), '[^A-Z0-9]+', '_', 'g') AS compact
  , p_partkey FROM (SELECT p_partkey, l || CASE WHEN p_partkey % 3 = 0 THEN '_' || coalesce(p_type, '') ELSE '' END AS name FROM (
    SELECT p_partkey, p_type, ([{", ".join(f"'{n}'" for n in label_names())}])[p_partkey % {len(label_names())} + 1] AS l FROM part))),
s AS (SELECT *, CASE WHEN name = 'FEATURE_Age_Over60' THEN name ELSE {_classify_sql(taxonomy.SOURCE, _REST)} END AS source,
  CASE WHEN contains(name, '具体未知') AND regexp_matches(name, '有|存在') THEN 'partial_unknown_detail' ELSE {_classify_sql(taxonomy.MISSING, "'not_missing_category'")} END AS missing FROM n)
SELECT p_partkey, name, {_classify_sql(taxonomy.FAMILY, "'other'")} AS family, missing, source,
  CASE WHEN missing = 'pure_missing_unknown' THEN 'unknown_missing_category' ELSE {_classify_sql(taxonomy.SEMANTIC, "'other_unique:' || source")} END AS semantic,
  {_classify_sql(taxonomy.THRESHOLD, "'train_median_exploratory'")} AS threshold,
  regexp_matches(trim(compact, '_'), '(^|_)(ALTER1|AGE_YEARS)$') AS raw_age,
  NOT regexp_matches(compact, '(^|_)(USAGE)(_|$)') AND NOT contains(compact, 'VEHUSAGE') AND {_decision_sql(taxonomy._AGE)} AS age_related FROM s"""


# Evidence of triplets


def _picked(spark, sf_dir) -> DataFrame:
    """The triplets that are tested: rule_id and the columns of a rule."""
    order = [F.desc(F.round("lift", 12)), F.desc(F.round("confidence", 12)), F.asc("antecedent")]
    capped = rules.axis_capped(R._valid_triplets(spark, sf_dir), "axis", order)
    placed = capped.withColumn("rule_id", F.format_string("T%02d", F.row_number().over(W.orderBy(*order))))
    kept = ("rule_id", "antecedent", "axis", "items", "bits", "families", "n_items", "clarity", "continuous", "lift", "best_parent_lift")
    return I.settled(placed.select(*kept).withColumnRenamed("lift", "train_lift"))


def _evidence(spark, sf_dir) -> DataFrame:
    picked = _picked(spark, sf_dir)
    train, test = R._split(spark, sf_dir, "train"), R._split(spark, sf_dir, "test")
    patterns = R._moved(spark, sf_dir)
    seen = rules.replay_of(R.unmoved(patterns), picked).withColumn("resolved", F.lit(True))
    table = picked.select("antecedent", "items", "bits", "continuous")
    boot = evidence.bootstrap(train, ITEMS, "y", "grp", table, R.ITERATIONS)
    moved = evidence.sensitivity_of(patterns, table)
    items = audit.item_replay(test, ITEMS).select("item", "unobserved_share").join(R.item_table(spark), "item")
    rows = triplets.with_validity(triplets.graded(seen, boot, moved), items)
    rows = rows.withColumn("value", triplets.value_flag(F.col("train_lift"), F.col("best_parent_lift")))
    return triplets.released(I.settled(rows))


FLAGS = "fixed_hit_ok threshold_hit_ok threshold_lift_ok threshold_stable physical_valid manuscript main_text supplementary".split()


def triplet_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("rule_id", "antecedent", "axis", "hit", R.r6("recurrence").alias("recurrence"), "tier", "use",
        "physical_tier", "value", *FLAGS)


_TIER_SQL = f"""CASE WHEN stat AND recurrence >= 0.95::DOUBLE AND fixed_hit_ok = 1 AND threshold_hit_ok = 1
  AND threshold_lift_ok = 1 THEN CASE WHEN continuous = 1 THEN '{evidence.CORE}' ELSE '{evidence.BINARY}' END
  WHEN stat THEN '{evidence.STATISTICAL}' ELSE '{evidence.REPLAYABLE}' END"""
EVIDENCE_SQL = f"""{R.TRIPLETS_SQL},
capped AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, antecedent) AS k FROM valid),
placed AS (SELECT antecedent, axis, lift AS train_lift, best_parent_lift, row_number() OVER (ORDER BY round(lift, 12) DESC, round(confidence,
  12) DESC, antecedent) AS n FROM capped WHERE k <= 3),
picked AS (SELECT triplets.* FROM triplets JOIN placed USING (antecedent) WHERE n <= 20),
{replay_sql("picked", "t")}, {R.bootstrap_sql("picked")}, {R.sensitivity_sql("picked")},
shares AS ({" UNION ALL ".join(f"SELECT '{i.name}' AS name, coalesce(count(*) FILTER (WHERE {R.hit_sql(i)} AND NOT {R.observed_sql(i)}) / nullif(count(*) FILTER (WHERE {R.hit_sql(i)}), 0)::DOUBLE, 0) AS share FROM facts WHERE split = 'test'" for i in ITEMS)}),
worst AS (SELECT antecedent, max(share) AS share FROM (SELECT antecedent, unnest(string_split(antecedent, '||')) AS name FROM picked)
  JOIN shares USING (name) GROUP BY antecedent),
ev AS (SELECT t.*, boot.recurrent / boot.n::DOUBLE AS recurrence, coalesce(t.hit >= 1 AND q_value <= 0.05::DOUBLE AND risk_ratio >= 1,
  false) AS stat, CAST(t.hit >= 5 AS INTEGER) AS fixed_hit_ok,
  CAST(coalesce(continuous = 0 OR hit_min >= 5, false) AS INTEGER) AS threshold_hit_ok, CAST(coalesce(continuous = 0 OR lift_min >= 1,
  false) AS INTEGER) AS threshold_lift_ok,
  CAST(worst.share < 0.5 AND duplicate = 0 AS INTEGER) AS physical_valid, printf('T%02d', placed.n) AS rule_id, placed.axis,
  CASE WHEN train_lift - best_parent_lift > 0 THEN 'incremental_lift' ELSE 'scene_context_only' END AS value
  FROM t JOIN boot USING (antecedent) LEFT JOIN sens USING (antecedent) JOIN worst USING (antecedent) JOIN placed USING (antecedent)),
tiers AS (SELECT *, threshold_hit_ok * threshold_lift_ok AS threshold_stable, {_TIER_SQL} AS tier FROM ev),
flagged AS (SELECT *, CASE tier {" ".join(f"WHEN '{t}' THEN '{u}'" for t, u in triplets.USES.items())} END AS use,
  CASE WHEN physical_valid = 1 THEN tier ELSE '{triplets.INVALID_TIER}' END AS physical_tier,
  CAST(physical_valid = 1 AND tier IN ('{evidence.CORE}', '{evidence.BINARY}', '{evidence.STATISTICAL}') AS INTEGER) AS manuscript,
  CAST(physical_valid = 1 AND tier IN ('{evidence.CORE}', '{evidence.BINARY}') AND threshold_stable = 1 AS INTEGER) AS main_text FROM tiers),
done AS (SELECT *, CAST(main_text = 0 OR tier NOT IN ('{evidence.CORE}', '{evidence.BINARY}') AS INTEGER) AS supplementary FROM flagged)"""
TRIPLET_EVIDENCE = f"""{EVIDENCE_SQL} SELECT rule_id, antecedent, axis, hit, round(recurrence, 6) AS recurrence, tier, use, physical_tier, value, {", ".join(FLAGS)} FROM done"""


def triplet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene and interpretation of every tested triplet, and its place in the main table if it has one."""
    rows = triplets.interpretation(_evidence(spark, sf_dir), taxonomy.scene(F.col("axis")))
    order = W.orderBy(evidence.tier_rank(F.col("tier")), F.desc_nulls_last("risk_ratio"), F.desc_nulls_last("hit"), F.asc("rule_id"))
    main = triplets.main_table(rows).select("rule_id", F.row_number().over(order).alias("place"))
    return rows.join(main, "rule_id", "left").select("rule_id", "tier", taxonomy.scene(F.col("axis")).alias("scene"), "interpretation", "place")


_SCENE_SQL = "CASE axis " + " ".join(f"WHEN '{a}' THEN '{s}'" for a, s in taxonomy.SCENES.items()) + " END"
TRIPLET_REPORT = f"""{EVIDENCE_SQL}, ranked AS (SELECT rule_id, row_number() OVER (ORDER BY CASE WHEN tier = '{evidence.CORE}' THEN 0 ELSE 1 END,
  risk_ratio DESC NULLS LAST, hit DESC NULLS LAST, rule_id) AS place FROM done WHERE main_text = 1)
SELECT rule_id, tier, {_SCENE_SQL} AS scene, CASE WHEN tier = '{evidence.STATISTICAL}' AND threshold_stable = 0 THEN '{triplets.SENSITIVE}'
  ELSE {_SCENE_SQL} END AS interpretation, place FROM done LEFT JOIN ranked USING (rule_id)"""


def triplet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.output_checks(_evidence(spark, sf_dir))


_CHECKS = ("no purely missing item in a reported rule", "no repeated meaning in a reported rule",
    "no item dominated by unknown values in a reported rule", "main text holds valid confirmed rules only")
_BAD_SQL = ("false", "duplicate = 1 AND manuscript = 1", "worst.share >= 0.5 AND manuscript = 1",
    f"main_text = 1 AND NOT (worst.share < 0.5 AND duplicate = 0 AND tier IN ('{evidence.CORE}', '{evidence.BINARY}'))")
TRIPLET_CHECKS = f"""{EVIDENCE_SQL}, counted AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (WHERE {b})::BIGINT AS n_bad FROM done JOIN worst USING (antecedent)" for c, b in zip(_CHECKS, _BAD_SQL, strict=True))})
SELECT name, CASE WHEN n_bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n_bad FROM counted"""


def main_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a main table reports, in its order."""
    graded = R._graded(spark, sf_dir)
    place = F.row_number().over(W.orderBy(evidence.tier_rank(F.col("tier")), F.desc_nulls_last("risk_ratio"), F.desc_nulls_last("hit"), F.asc("antecedent")))
    return evidence.main_table(graded).select(place.alias("place"), "antecedent", "tier", R.r6("risk_ratio").alias("risk_ratio"), "hit",
        evidence.recommended_use(F.col("tier")).alias("use"))


MAIN_RULE_TABLE = f"""{R.GRADED_SQL} SELECT row_number() OVER (ORDER BY CASE tier {" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(evidence.TIER_ORDER))} END,
  risk_ratio DESC NULLS LAST, hit DESC NULLS LAST, antecedent) AS place,
  antecedent, tier, round(risk_ratio, 6) AS risk_ratio, hit,
  CASE tier WHEN '{evidence.CORE}' THEN 'priority governance target' WHEN '{evidence.BINARY}' THEN 'targeted governance signal'
  ELSE 'replay reference' END AS use
FROM graded WHERE tier IN ('{evidence.CORE}', '{evidence.BINARY}', '{evidence.REPLAYABLE}')"""


def resolve_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the items of every mined pair are found in a manifest that lacks some, and which pairs are left without those."""
    known = [i.name for i in ITEMS if i.continuous]
    table = R._mined(spark, sf_dir).select("antecedent", "items")
    kept = triplets.without_items(table, [i.name for i in ITEMS if not i.continuous]).select("antecedent", F.lit(1).alias("kept"))
    return table.select("antecedent", rules.resolve_trace(F.col("items"), known).alias("trace")).join(kept, "antecedent", "left").withColumn("kept",
        F.coalesce("kept", F.lit(0)))


RESOLVE_TRACE = f"""{R.BASE_SQL}, {evaluated_sql("pairs", "train", "e2")}, each AS (SELECT antecedent, name, continuous FROM (SELECT antecedent, unnest(string_split(antecedent,
  '||')) AS name FROM e2 WHERE support >= {R.SUPPORT}::DOUBLE AND lift >= {R.LIFT}::DOUBLE) JOIN items USING (name))
SELECT antecedent, string_agg(name || ':' || CASE WHEN continuous = 1 THEN 'resolved' ELSE 'missing_manifest' END, ' | ' ORDER BY name) AS trace,
  min(continuous) AS kept FROM each GROUP BY antecedent"""


def candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    free, mined = R.unconstrained_triplets(spark, sf_dir), R.arm_triplets(spark, sf_dir)
    first = {"unconstrained": free.where("in_top50"), "association": mined.where(F.substring("rule_id", 4, 9).cast("int") <= 50)}
    test = R._replayed(spark, sf_dir, (3,)).where("hit > 0").select("antecedent")
    return audit.candidate_audit({"unconstrained": free, "association": mined}, {m: f.join(test, "antecedent") for m, f in first.items()})


_PLACE_SQL = "row_number() OVER (ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, antecedent) AS place"
CANDIDATE_AUDIT = f"""{R.TRIPLETS_SQL}, {replay_sql("triplets", "t").replace("continuous, clarity, n_items, duplicate,", "")},
a AS (SELECT antecedent, {_PLACE_SQL} FROM full3 WHERE support >= {R.SUPPORT}::DOUBLE AND hit >= {R.TRIPLET_HITS} AND lift >= {R.LIFT}::DOUBLE),
b AS (SELECT antecedent, {_PLACE_SQL} FROM e3 WHERE support >= {R.SUPPORT}::DOUBLE AND lift >= {R.LIFT}::DOUBLE),
u AS (SELECT 'unconstrained' AS method, * FROM a UNION ALL SELECT 'association', * FROM b)
SELECT method, count(*) AS n_candidates, count(*) FILTER (WHERE place <= 50 AND t.hit > 0) AS n_replayed FROM u LEFT JOIN t USING (antecedent) GROUP BY method"""


# Flags, ages, formats and checks


def flag_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose flags are 0, 1, null, or of no row: by row id, never by place."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "value", "event_type")
    flags = rows.where("row_id % 11 <> 0").select("row_id", F.when(F.col("row_id") % 7 != 0, (F.col("row_id") % 5 == 0).cast("int")).alias("value"))
    told = prep.with_flags(rows, flags, ["value", "event_type"], strict=False)
    return told.groupBy("_unobserved_value",
        "_unobserved_event_type").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({"_unobserved_value": "value", "_unobserved_event_type": "event_type"})


FLAG_ALIGNMENT = "SELECT event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0 AS value, false AS event_type, count(*) AS n FROM events GROUP BY 1"


def age_over60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages as they are typed: with words, coded as unknown, beyond all ages, or absent."""
    raw = F.when(F.col("p_size") > 45, "999-未知").when(F.col("p_size") > 40, "130").when(F.col("p_size") == 1,
        None).otherwise(F.concat((F.col("p_size") * 2).cast("string"), F.lit(" years")))
    found = prep.over_age_audit(facts(spark, sf_dir).select("split", raw.alias("age")), "age")
    return found.withColumns({c: R.r6(c) for c in ("over_rate", "unknown_rate")})


AGE_OVER60 = f"""{WITH}, a AS (SELECT split, CASE WHEN p_size BETWEEN 2 AND 40 THEN p_size * 2 END AS age FROM facts)
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE age > 60) AS n_over, round(count(*) FILTER (WHERE age > 60) / count(*)::DOUBLE, 6) AS over_rate,
  count(*) - count(age) AS n_unknown, round((count(*) - count(age)) / count(*)::DOUBLE, 6) AS unknown_rate FROM a GROUP BY split"""


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.concat_ws("_", "p_type", "p_size").alias("name"))
    return prep.unique_names(part)


UNIQUE_NAMES = """WITH n AS (SELECT p_partkey AS place, concat_ws('_', p_type, p_size) AS name, row_number() OVER (PARTITION BY p_type, p_size
  ORDER BY p_partkey) - 1 AS k FROM part)
SELECT place, name, CASE WHEN k = 0 THEN name ELSE name || '__dup' || k END AS unique_name FROM n"""


def formatted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell of text per feature and split, as a table of characteristics has them."""
    f = facts(spark, sf_dir).withColumn("open", (F.col("l_linestatus") == "O").cast("int"))
    features = ["qty", "p_size", "open"]
    s = profile.summary(profile.long_form(stored(f.select("split", *features)), ["split"], features), ["split", "feature"])
    of_flag = text.count_summary(F.round(F.col("mean") * F.col("n")), F.col("mean"))
    return s.select("split", "feature",
        F.when(F.col("feature") == "open", of_flag).otherwise(text.spread_summary(*(F.col(c) for c in ("mean", "sd", "median", "q1", "q3")))).alias("cell"))


FORMATTED_BASELINE = f"""{WITH}, v AS (SELECT split, 'qty' AS feature, qty::DOUBLE AS value FROM facts UNION ALL SELECT split, 'p_size', p_size
  FROM facts UNION ALL SELECT split, 'open', CAST(l_linestatus = 'O' AS INTEGER) FROM facts)
SELECT split, feature, CASE WHEN feature = 'open' THEN printf('%d (%.1f%%)', sum(value)::BIGINT, avg(value) * 100)
  ELSE printf('%.3f ± %.3f; %.3f [%.3f, %.3f]', avg(value), stddev_samp(value), median(value), quantile_cont(value, 0.25), quantile_cont(value,
  0.75)) END AS cell FROM v GROUP BY split, feature"""


def capped_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_type").agg(text.capped_list(F.concat_ws(" ", "p_brand", "p_size"), 20).alias("levels"),
        text.short_label(F.concat(F.lit("  all\n of "), F.first("p_type")), 9).alias("label"))


CAPPED_LEVELS = """SELECT p_type, array_to_string(list_slice(list_sort(list(DISTINCT p_brand || ' ' || p_size)), 1, 20), '||') AS levels, left('all of ' || p_type, 9) AS label FROM part GROUP BY p_type"""


def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    custkeys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    ordering = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    sides = {"customers of orders": (custkeys, ordering), "orders twice": (ordering, ordering.union(ordering))}
    found = [audit.same_rows(a, b, ["key"]).withColumn("name", F.lit(n)) for n, (a, b) in sides.items()]
    return found[0].unionByName(found[1])


SET_EQUALITY = """WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), d AS (SELECT (SELECT count(*) FROM customer
  WHERE c_custkey NOT IN (SELECT k FROM o)) AS n_only_a, (SELECT count(*) FROM o WHERE k NOT IN (SELECT c_custkey FROM customer)) AS n_only_b)
SELECT 'customers of orders' AS name, n_only_a, n_only_b, n_only_a + n_only_b = 0 AS equal FROM d UNION ALL SELECT 'orders twice', 0, 0, true"""


_MASS = [
    ("VEH_GEWGES", "vehicle_mass", "vehicle_mass", "vehicle_mass_speed_energy"), ("x_碰撞时的总重", "vehicle_size", "vehicle_mass", "crash_configuration"),
    ("GEWGES_2", "crash_type", "other_unique:x", "speed_energy"),
        ("VEH_LAENGE", "vehicle_size", "vehicle_geometry_length", "vehicle_geometry_interaction"), ("GEWGES_3", None, "vehicle_mass", None),
]


def mass_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a manifest per part: which of them call total mass something else."""
    names = ("source", "family", "semantic", "axis")
    known = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, row, strict=True))) for row in _MASS))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.get(known, (F.col("p_partkey") % len(_MASS)).cast("int")).alias("m")).select("p_partkey", "m.*")
    return audit.mass_violations(rows).select("p_partkey", "source", "violation")


MASS_VIOLATIONS = """WITH k(i, source, family, semantic, axis) AS (VALUES """ + ", ".join(f"({i}, " + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for i, r in enumerate(_MASS)) + f"""),
m AS (SELECT p_partkey, k.* FROM part JOIN k ON k.i = p_partkey % {len(_MASS)}),
v AS (SELECT p_partkey, source, concat_ws('|', CASE WHEN coalesce(family, '') <> 'vehicle_mass' THEN 'family!=vehicle_mass' END, CASE WHEN coalesce(semantic,
  '') <> 'vehicle_mass' THEN 'Semantic_Group!=vehicle_mass' END,
  CASE WHEN axis IN ('crash_configuration', 'vehicle_geometry_interaction') THEN 'Mechanism_Axis_forbidden' END) AS violation FROM m
  WHERE regexp_matches(source, 'GEWGES|碰撞时的总重'))
SELECT p_partkey, source, violation FROM v WHERE violation <> ''"""


def fixed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("unwanted"))
    return prep.with_schema(nation, ["name", "absent"])


FIXED_SCHEMA = "SELECT n_name AS name, NULL::VARCHAR AS absent FROM nation"

# More of texts, items and checks


def key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, names and flags as they come, in one form."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 6).alias("k"))
    raw = F.when(F.col("k") == 0, F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit(".0 "))).when(F.col("k") == 1,
        "nan").when(F.col("k") == 2, "").when(F.col("k") == 3, "None").when(F.col("k") == 4, "a.0.0")
    flag = F.when(F.col("k") == 0, " TRUE").when(F.col("k") == 1, "0.0").when(F.col("k") == 2, "1").when(F.col("k") == 3, "false ").when(F.col("k") == 4, "2")
    threshold = F.col("k") - 2.5
    operator = F.when(F.col("k") % 3 == 0, ">").when(F.col("k") % 3 == 1, "<=").otherwise("==")
    return e.select(
        "event_id",
        text.normalize_key(raw).alias("key"),
        text.binary(flag).alias("flag"),
        text.item_name(F.col("event_type"), operator, threshold).alias("item"),
        text.sanitized(F.concat(F.lit("(["), F.col("event_type"), F.lit("] ;:"), F.col("k").cast("string"), F.lit(")"))).alias("name"),
    )


KEY_TEXTS = r"""WITH e AS (SELECT event_id, event_type, event_id % 6 AS k FROM events),
r AS (SELECT *, CASE k WHEN 0 THEN '  ' || event_id || '.0 ' WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN 'None' WHEN 4 THEN 'a.0.0' END AS raw FROM e)
SELECT event_id, CASE WHEN regexp_replace(trim(raw), '\.0$', '') NOT IN ('nan', 'None', '', '<NA>') THEN regexp_replace(trim(raw), '\.0$', '') END AS key,
  CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS flag,
  event_type || '___' || CASE k % 3 WHEN 0 THEN 'GT' WHEN 1 THEN 'LE' ELSE 'EQ' END || '_' || translate((k - 2.5)::DOUBLE::VARCHAR, '.-', '_m') AS item, event_type || '_' || k AS name FROM r"""

MEDIANS = [I.Item("INITIAL_SPEED___MEDIAN", "qty", ">", "median", "speed_v0"),
    I.Item("FRICTION___MEDIAN", "disc", "<=", "median", "road_surface", (0.0,)),
    I.Item("VEHICLE_LENGTH___MEDIAN", "p_size", ">", "median", "vehicle_size")]


def median_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose thresholds are the training medians of observed values, and how often they are hit."""
    f = facts(spark, sf_dir)
    fitted = I.fit_thresholds(f.where("split = 'train'"), MEDIANS)
    at = I.local(spark, [(i.name, float(i.threshold), i.clarity) for i in fitted], "item string, threshold double, clarity double")
    return audit.item_replay(f, fitted).join(at, "item").select("item", "split", "threshold", "clarity", "n_hits", R.r6("hit_rate").alias("hit_rate"))


MEDIAN_ITEMS = f"""{WITH},
  long AS ({" UNION ALL ".join(f"SELECT '{i.name}' AS item, split, {i.source}::DOUBLE AS value, {R.observed_sql(i)} AS seen, '{i.operator}' AS op FROM facts" for i in MEDIANS)}),
m AS (SELECT item, median(value) AS threshold FROM long WHERE split = 'train' AND seen GROUP BY item),
h AS (SELECT item, split, any_value(threshold) AS threshold, count(*) AS n, count(*) FILTER (WHERE seen AND CASE WHEN op = '>' THEN value > threshold
  ELSE value <= threshold END) AS n_hits FROM long JOIN m USING (item) GROUP BY item, split)
SELECT item, split, threshold, 0.7::DOUBLE AS clarity, n_hits, round(n_hits / n::DOUBLE, 6) AS hit_rate FROM h"""


def consensus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted blend of what two screeners say; parts that nobody measured count nothing."""
    fused = table_queries.rank_fusion(spark, sf_dir)
    parts = {"mean_points": F.col("mean_points"), "vote_share": F.col("votes") / 2, "stability": F.lit(None).cast("double"),
        "permutation": F.lit(0.0), "priority": F.col("feature").isin("qty", "price").cast("double")}
    return fused.select("feature", R.r6(screening.consensus(parts)).alias("score"))


CONSENSUS_SCORES = f"""WITH f AS ({table_queries.RANK_FUSION}) SELECT feature, round(0.40::DOUBLE * mean_points + 0.24::DOUBLE * (votes / 2.0::DOUBLE) + 0.15::DOUBLE * CASE WHEN feature IN ('qty', 'price') THEN 1 ELSE 0 END, 6) AS score FROM f"""


def sweep_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pairs that the first N items give on training rows do on test rows, N = 4, 6, 8, 10."""
    found = R._mined(spark, sf_dir).select("bits", F.col("lift").alias("train_lift"))
    both = R._replayed(spark, sf_dir).join(found, "bits")
    each = both.select("*", F.explode(F.array(*map(F.lit, (4, 6, 8, 10)))).alias("n_features")).where(F.col("bits") < F.pow(F.lit(2.0), F.col("n_features")))
    return each.groupBy("n_features").agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.count_if(F.col("risk_ratio") >= 1).alias("n_risk"),
        F.count_if(F.col("q_value") <= 0.05).alias("n_significant"),
        R.r6(F.median("risk_ratio")).alias("median_risk_ratio"),
        R.r6(F.max("train_lift")).alias("best_train_lift"),
    )


SWEEP_REPLAY = f"""{R.BASE_SQL}, {evaluated_sql("pairs", "train", "e2")}, {replay_sql("pairs", "t")},
b AS (SELECT t.*, e2.lift AS train_lift FROM t JOIN e2 USING (bits) WHERE e2.support >= {R.SUPPORT}::DOUBLE AND e2.lift >= {R.LIFT}::DOUBLE)
SELECT n AS n_features, count(*) AS n_rules, count(*) FILTER (WHERE risk_ratio >= 1) AS n_risk,
  count(*) FILTER (WHERE q_value <= 0.05::DOUBLE) AS n_significant, round(median(risk_ratio), 6) AS median_risk_ratio,
  round(max(train_lift), 6) AS best_train_lift FROM b, (VALUES (4), (6), (8), (10)) s(n) WHERE bits < (1 << n) GROUP BY n"""


def core_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many graded pairs hold each item, per tier."""
    return evidence.item_usage(R._graded(spark, sf_dir), R.item_table(spark).select("item", "family"))


_TIER_COUNTS = ", ".join(f"count(*) FILTER (WHERE tier = '{t}') AS {n}" for n,
    t in (("n_core", evidence.CORE), ("n_binary", evidence.BINARY), ("n_statistical", evidence.STATISTICAL)))
CORE_USAGE = f"""{R.GRADED_SQL}, each AS (SELECT tier, unnest(string_split(antecedent, '||')) AS item FROM graded), u AS (SELECT item,
  count(*) AS n_rules, {_TIER_COUNTS} FROM each GROUP BY item)
SELECT name AS item, family, coalesce(n_rules, 0) AS n_rules, coalesce(n_core, 0) AS n_core, coalesce(n_binary, 0) AS n_binary,
  coalesce(n_statistical, 0) AS n_statistical,
  CAST(coalesce(n_core, 0) + coalesce(n_binary, 0) > 0 AS INTEGER) AS used_in_core FROM items LEFT JOIN u ON u.item = items.name"""


def _rule_checks() -> list[tuple[str, str, str]]:
    """Name, aggregate condition in Spark, and in DuckDB, over graded pairs."""
    same = [
        ("all_pairs_graded", "count(*) = 45"),
        ("antecedents_unique", "count(DISTINCT antecedent) = count(*)"),
        ("hits_within_rows", "max(hit) <= min(total) AND min(hit) >= 0"),
        ("label_within_hits", "min(hit - hit_y) >= 0"),
        ("confidence_is_a_share", "min(test_confidence) >= 0 AND max(test_confidence) <= 1"),
        ("wilson_holds_confidence", "max(CASE WHEN wilson_lower > test_confidence + 1e-12 OR wilson_upper < test_confidence - 1e-12 THEN 1 ELSE 0 END) = 0"),
        ("q_at_least_p", "max(CASE WHEN q_value < p_value - 1e-12 THEN 1 ELSE 0 END) = 0"),
        ("q_at_most_one", "max(q_value) <= 1"),
        ("unhit_has_no_p", "max(CASE WHEN hit = 0 AND p_value IS NOT NULL THEN 1 ELSE 0 END) = 0"),
        ("recurrence_is_a_share", "min(recurrence) >= 0 AND max(recurrence) <= 1"),
        ("moved_hits_at_most_hits", "max(CASE WHEN hit_min > hit THEN 1 ELSE 0 END) = 0"),
        ("tiers_known", f"max(CASE WHEN tier IN ({', '.join(map(repr, evidence.TIER_ORDER))}) THEN 0 ELSE 1 END) = 0"),
        ("axes_known", f"max(CASE WHEN axis IN ({', '.join(map(repr, R.AXIS_LABELS))}) THEN 0 ELSE 1 END) = 0"),
        ("confirmed_is_significant",
            f"max(CASE WHEN tier IN ('{evidence.CORE}', '{evidence.BINARY}', '{evidence.STATISTICAL}') AND q_value > 0.05 THEN 1 ELSE 0 END) = 0"),
        ("core_recurs", f"max(CASE WHEN tier IN ('{evidence.CORE}', '{evidence.BINARY}') AND recurrence < 0.95 THEN 1 ELSE 0 END) = 0"),
        ("every_rule_significant", "max(q_value) <= 0.05"),
    ]
    return [(n, c, c) for n, c in same]


def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the graded pairs in one pass; the last one is not expected to hold."""
    holds = [(n, F.coalesce(F.expr(c), F.lit(False))) for n, c, _ in _rule_checks()]
    row = R._graded(spark, sf_dir).agg(*(c.alias(n) for n, c in holds))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.when(F.col(n), "PASS").otherwise("FAIL").alias("status")) for n, _ in holds))))


RULE_CHECKS = f"{R.GRADED_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN {c} THEN 'PASS' ELSE 'FAIL' END AS status FROM graded" for n,
    _, c in _rule_checks())

def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every graded pair is called, asks for, and where it may be reported."""
    g = R._graded(spark, sf_dir)
    labels = {"interpretation": taxonomy.interpretation(F.col("families")), "strength": evidence.strength_label(F.col("tier")), "place": evidence.manuscript_place(F.col("tier"))}
    return g.select("antecedent", *(c.alias(n) for n, c in labels.items()))


def _mapped(table: dict[str, str], otherwise: str) -> str:
    return "CASE tier " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{otherwise}' END"


_ACTIONS = ", ".join(f"CASE WHEN list_has_any(families, [{', '.join(map(repr, own))}]) THEN '{action}' END" for own, action in taxonomy.ACTIONS)
RULE_LABELS = f"""{R.GRADED_SQL} SELECT antecedent, coalesce(nullif(concat_ws('; ', {_ACTIONS}), ''), '{taxonomy.NO_ACTION}') AS interpretation,
  {_mapped(evidence.STRENGTH, evidence.NO_STRENGTH)} AS strength, {_mapped(evidence.PLACE, evidence.NO_PLACE)} AS place FROM graded"""


def axis_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every axis with the numbers of its graded and mined pairs, and what it contributes."""
    axes = I.local(spark, [(a,) for a in R.AXIS_LABELS], "axis string")
    graded = evidence.axis_summary(R._graded(spark, sf_dir)).select("axis", "n_core", "n_binary", "n_statistical", "n_replayable")
    counted = evidence.spine(axes, {"n_universe": R._mined(spark, sf_dir).withColumn("axis", R.axis())}).join(graded, "axis", "left")
    counted = counted.na.fill(0, ["n_core", "n_binary", "n_statistical", "n_replayable"])
    return counted.withColumn("role", evidence.coverage_role(F.col("n_core"), F.col("n_binary"), F.col("n_replayable"), F.lit(0), F.col("n_universe")))


AXIS_ROLES = f"""{R.GRADED_SQL}, {evaluated_sql("pairs", "train", "e2")}, axes(axis) AS (VALUES {", ".join(f"('{a}')" for a in R.AXIS_LABELS)}),
m AS (SELECT {R.axis_sql()} AS axis, count(*) AS n_universe FROM e2 WHERE support >= {R.SUPPORT}::DOUBLE AND lift >= {R.LIFT}::DOUBLE GROUP BY 1),
g AS (SELECT axis, {_TIER_COUNTS}, count(*) FILTER (WHERE tier = '{evidence.REPLAYABLE}') AS n_replayable FROM graded GROUP BY axis),
j AS (SELECT axis, coalesce(n_universe, 0) AS n_universe, coalesce(n_core, 0) AS n_core, coalesce(n_binary, 0) AS n_binary, coalesce(n_statistical, 0) AS n_statistical, coalesce(n_replayable, 0) AS n_replayable
  FROM axes LEFT JOIN m USING (axis) LEFT JOIN g USING (axis))
SELECT *, CASE WHEN n_core + n_binary > 0 THEN 'confirmed primary evidence' WHEN n_replayable > 0 THEN 'replayable governance cue' WHEN n_universe > 0 THEN 'present in train-mined universe but not confirmed'
  ELSE 'not observed under current train-only candidate criteria' END AS role FROM j"""


def complexity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the first N items compare as a space of rules."""
    sweep = R.size_sweep(spark, sf_dir).select("n_features", "n_triplets")
    concentration = R.herfindahl(spark, sf_dir).where("n_items = 3").select("herfindahl")
    label = evidence.complexity_class(F.lit(0), F.col("n_triplets"), F.col("herfindahl"), F.col("n_features"), balance=10)
    return sweep.crossJoin(F.broadcast(concentration)).select("n_features", "n_triplets", label.alias("complexity"))  # one row


COMPLEXITY_CLASSES = f"""WITH s AS ({R.SIZE_SWEEP}), h AS ({R.HERFINDAHL})
SELECT n_features, n_triplets, CASE WHEN n_triplets > 5000 OR herfindahl > 0.45::DOUBLE THEN 'higher_rule_complexity_or_axis_concentration' WHEN n_features = 10 THEN 'primary_balance_point'
  ELSE 'sensitivity_comparator_only' END AS complexity FROM s, h WHERE n_items = 3"""

NAMES = (
    "name_labels triplet_evidence triplet_report triplet_checks main_rule_table resolve_trace candidate_audit flag_alignment age_over60 unique_names formatted_baseline capped_levels set_equality mass_violations fixed_schema "
    "key_texts median_items consensus_scores sweep_replay core_usage rule_checks rule_labels axis_roles complexity_classes"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
