"""Rules over manifests of 25 to 35 items, from one written index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimine.functions import stats
from evimine.operators import bitmaps, rules, triplets
from evimine.operators import items as I
from evimine.operators.items import Item
from evimine.plans.facts import EVIDENCE_SQL, FACTS_SQL, ITEMS, facts, hit_sql
from evimine.plans.rule_queries import SCORE_SQL, r6

#: Items of the primary manifest, sizes that are compared, and floors of a rule.
PRIMARY, SIZES = 25, (15, 20, 25, 30, 35)
SUPPORT, LIFT, HITS = 0.015, 1.0, 40

WIDE = [
    *ITEMS,
    Item("INITIAL_SPEED___GT_20", "qty", ">", 20.0, "speed_v0"),
    Item("IMPACT_SPEED___LE_20000", "price", "<=", 20000.0, "speed_vk"),
    Item("FRICTION___LE_0_02", "disc", "<=", 0.02, "road_surface", (0.0,)),
    Item("NIGHT_SHARE___LE_0_02", "tax", "<=", 0.02, "light", (0.0,)),
    Item("FEATURE_AGE___LE_1000", "s_acctbal", "<=", 1000.0, "age"),
    Item("VEHICLE_LENGTH___GT_40", "p_size", ">", 40, "vehicle_size"),
    Item("VEHICLE_MASS___GT_250000", "o_totalprice", ">", 250000.0, "vehicle_mass"),
    Item("ROAD_TYPE_O", "o_orderstatus", "==", "O", "road_type"),
    Item("AEB_HIGH", "o_orderpriority", "==", "2-HIGH", "safety"),
    Item("WEATHER_ECONOMY", "p_type", "==", "ECONOMY", "weather"),
    Item("LANE_LARGE", "p_type", "==", "LARGE", "lane"),
    Item("LIGHT_PROMO", "p_type", "==", "PROMO", "light"),
    Item("VEHICLE_MASS___LE_100000", "o_totalprice", "<=", 100000.0, "vehicle_mass"),
    Item("IMPACT_SPEED___GT_40000", "price", ">", 40000.0, "speed_vk"),
    Item("AEB_MEDIUM", "o_orderpriority", "==", "3-MEDIUM", "safety"),
    Item("WEATHER_SMALL", "p_type", "==", "SMALL", "weather"),
    Item("LANE_MEDIUM", "p_type", "==", "MEDIUM", "lane"),
    Item("LIGHT_STANDARD", "p_type", "==", "STANDARD", "light"),
    Item("ROAD_TYPE_P", "o_orderstatus", "==", "P", "road_type"),
    Item("AEB_LOW", "o_orderpriority", "==", "5-LOW", "safety"),
    Item("INITIAL_SPEED___GT_40", "qty", ">", 40.0, "speed_v0", (), "exploratory_high"),
    Item("FRICTION___GT_0_08", "disc", ">", 0.08, "road_surface", (0.0,), "exploratory_high"),
    Item("NIGHT_SHARE___GT_0_06", "tax", ">", 0.06, "light", (0.0,), "exploratory_high"),
    Item("VEHICLE_LENGTH___LE_10", "p_size", "<=", 10, "vehicle_size", (), "exploratory_low"),
    Item("FEATURE_AGE___GT_8000", "s_acctbal", ">", 8000.0, "age", (), "exploratory_high"),
]


def _index(spark, sf_dir, n: int) -> DataFrame:
    return bitmaps.index(facts(spark, sf_dir), WIDE[:n], "y")


def wide_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent sets of two to four of 25 items that raise the label, ranked."""
    train = _index(spark, sf_dir, PRIMARY).where("split = 'train'")
    sets = bitmaps.frequent_sets(train, (2, 4), SUPPORT)
    found = I.measures(bitmaps.evaluate(train, WIDE, sets)).where((F.col("support") >= SUPPORT) & (F.col("lift") >= LIFT))
    return rules.ranked(found).select("antecedent", "n_items", "hit", "hit_y", *(r6(c).alias(c) for c in ("support", "confidence", "lift", "score")), F.col("candidate_rank").cast("long").alias("candidate_rank"))


def _manifest_sql(n: int) -> str:
    values = ", ".join(f"({i}, '{x.name}', {1 << i}::BIGINT, '{x.family}', {x.clarity}::DOUBLE, {int(x.continuous)}, '{x.source}')" for i, x in enumerate(WIDE[:n]))
    bits = " + ".join(f"CASE WHEN {hit_sql(x)} THEN {1 << i}::BIGINT ELSE 0::BIGINT END" for i, x in enumerate(WIDE[:n]))
    return f"""WITH {FACTS_SQL}, items(place, name, bit, family, clarity, continuous, source) AS (VALUES {values}),
pat AS (SELECT split, bits, count(*)::BIGINT AS n, sum(y)::BIGINT AS y FROM (SELECT split, y, {bits} AS bits FROM facts) GROUP BY ALL),
tot AS (SELECT split, sum(n)::BIGINT AS total, sum(y)::BIGINT AS positives FROM pat GROUP BY split)"""


def _sets_sql(size: int, floor: str = "") -> str:
    """CTEs s1..ssize: sets in order of the items' places, with hits on training rows; each grown from those before that reach the floor."""
    first = """s1 AS (SELECT [name] AS names, [family] AS fams, [source] AS srcs, bit AS bits, place, clarity AS clear, continuous FROM items)"""
    steps = [first]
    for k in range(2, size + 1):
        steps.append(f"""g{k} AS (SELECT list_append(a.names, b.name) AS names, list_append(a.fams, b.family) AS fams, list_append(a.srcs, b.source) AS srcs, a.bits + b.bit AS bits, b.place, a.clear + b.clarity AS clear,
  greatest(a.continuous, b.continuous) AS continuous FROM s{k - 1} a JOIN items b ON b.place > a.place),
c{k} AS (SELECT g.bits, coalesce(sum(p.n), 0)::BIGINT AS hit, coalesce(sum(p.y), 0)::BIGINT AS hit_y FROM g{k} g LEFT JOIN (SELECT * FROM pat WHERE split = 'train') p ON (p.bits & g.bits) = g.bits GROUP BY g.bits),
s{k} AS (SELECT g.*, c.hit, c.hit_y FROM g{k} g JOIN c{k} c USING (bits), (SELECT * FROM tot WHERE split = 'train') t{f' WHERE {floor}' if floor else ''})""")
    return ", ".join(steps)


_RULE_SQL = """SELECT array_to_string(list_sort(names), '||') AS antecedent, list_sort(list_distinct(fams)) AS families, srcs, bits, clear / len(names) AS clarity, len(names)::INTEGER AS n_items, continuous, hit, hit_y,
  hit_y / total::DOUBLE AS support, hit_y / nullif(hit, 0)::DOUBLE AS confidence, hit_y / nullif(hit, 0)::DOUBLE / (positives / total::DOUBLE) AS lift FROM {source}, (SELECT * FROM tot WHERE split = 'train')"""
_FLOOR = f"hit_y / total::DOUBLE >= {SUPPORT}::DOUBLE"
WIDE_RULES = f"""{_manifest_sql(PRIMARY)}, {_sets_sql(4, _FLOOR)}, u AS ({" UNION ALL ".join(_RULE_SQL.format(source=f"s{k}") for k in (2, 3, 4))})
SELECT antecedent, n_items, hit, hit_y, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round({SCORE_SQL}, 6) AS score,
  row_number() OVER (ORDER BY round({SCORE_SQL}, 12) DESC, round(lift, 12) DESC, antecedent) AS candidate_rank FROM u WHERE lift >= {LIFT}::DOUBLE"""


def _both_sides(blocks: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """Measures of each set on training rows, and its evidence on test rows."""
    found = bitmaps.evaluate(blocks, WIDE, sets)
    train = I.measures(found.where("split = 'train'")).drop("split")
    test = found.where("split = 'test'").select("k", *(F.col(c).alias(f"test_{c}") for c in ("total", "positives", "hit", "hit_y")))
    return train.join(test, "k", "left")


def _evidence(both: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """k (and by) with the test columns, risk ratio, exact p-value and q-value."""
    test = both.select(*by, "k", *(F.col(f"test_{c}").alias(c) for c in ("total", "positives", "hit", "hit_y")))
    base = F.col("positives") / F.nullif(F.col("total"), F.lit(0))
    ratio = F.col("hit_y") / F.nullif(F.col("hit"), F.lit(0)) / F.nullif(base, F.lit(0.0))
    scored = test.select(*by, "k", ratio.alias("risk_ratio"), stats.binomial_tail(F.col("hit_y"), F.col("hit"), base).alias("p_value"))
    return stats.benjamini_hochberg(scored, "p_value", "q_value", by)


def wide_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 2,300 triplets of 25 items: training lift against the best of their pairs, admission, and evidence on test rows."""
    blocks = _index(spark, sf_dir, PRIMARY)
    pairs = I.measures(bitmaps.evaluate(blocks.where("split = 'train'"), WIDE, bitmaps.all_sets(PRIMARY, 2)))
    three = _both_sides(blocks, bitmaps.all_sets(PRIMARY, 3))
    rows = [(i.name, i.family, i.name, i.source, "not_missing_category", 1) for i in WIDE[:PRIMARY]]
    manifest = I.local(spark, rows, "item string, family string, semantic string, source string, missing string, physical int")
    ok = triplets.admitted(three, manifest).select("k", F.lit(1).alias("ok"))
    found = rules.with_parents(three, pairs.withColumn("bits", F.lit(0))).join(_evidence(three), "k").join(ok, "k", "left")
    floors = (F.col("hit") / F.col("total") >= SUPPORT) & (F.col("hit") >= HITS) & (F.col("lift") >= LIFT)
    valid = F.when(floors & F.col("ok").isNotNull(), 1).otherwise(0)
    columns = ("lift", "best_parent_lift", "incremental_lift", "risk_ratio", "p_value", "q_value")
    return found.select("antecedent", "hit", "hit_y", F.coalesce("test_hit", F.lit(0)).alias("test_hit"), *(r6(c).alias(c) for c in columns), valid.alias("valid"))


_TEST_SQL = """SELECT g.bits, coalesce(sum(p.n), 0)::BIGINT AS hit, coalesce(sum(p.y), 0)::BIGINT AS hit_y FROM {source} g LEFT JOIN (SELECT * FROM pat WHERE split = 'test') p
  ON (p.bits & g.bits) = g.bits GROUP BY g.bits"""


def _evidence_sql(source: str, extra: str = "") -> str:
    """EVIDENCE_SQL over (bits, hit, hit_y) of test rows, without columns of the rules."""
    rows = f"""(SELECT *, hit_y / nullif(hit, 0)::DOUBLE AS confidence, hit_y / nullif(hit, 0)::DOUBLE / (positives / total::DOUBLE) AS lift FROM {source}, (SELECT total, positives FROM tot WHERE split = 'test'))"""
    return EVIDENCE_SQL.format(source=rows).replace("antecedent, bits, families, continuous, clarity, n_items, duplicate,", f"bits, {extra}")


_CORE = ", ".join(map(repr, triplets.CORE_FAMILIES))
WIDE_TRIPLETS = f"""{_manifest_sql(PRIMARY)}, {_sets_sql(3)}, e2 AS ({_RULE_SQL.format(source="s2")}), e3 AS ({_RULE_SQL.format(source="s3")}),
bit AS (SELECT bits, unnest(list_filter([1::BIGINT << i FOR i IN range({PRIMARY})], lambda b: bits & b > 0)) AS one FROM e3),
parents AS (SELECT b.bits, max(e2.lift) AS best_parent_lift FROM bit b JOIN e2 ON e2.bits = b.bits - b.one GROUP BY b.bits),
th AS ({_TEST_SQL.format(source="s3")}), tp AS ({_evidence_sql("th")}),
tr AS (SELECT *, row_number() OVER (PARTITION BY p_value IS NOT NULL ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY p_value IS NOT NULL) AS m FROM tp),
tq AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1::DOUBLE, min(p_value * m / rk) OVER (PARTITION BY p_value IS NOT NULL ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END AS q_value FROM tr)
SELECT antecedent, e3.hit, e3.hit_y, tq.hit AS test_hit, round(lift, 6) AS lift, round(best_parent_lift, 6) AS best_parent_lift, round(lift - best_parent_lift, 6) AS incremental_lift,
  round(risk_ratio, 6) AS risk_ratio, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value,
  CAST(coalesce(len(list_distinct(srcs)) = 3 AND len(families) >= 2 AND list_has_any(families, [{_CORE}]) AND e3.hit / t.total::DOUBLE >= {SUPPORT}::DOUBLE AND e3.hit >= {HITS} AND lift >= {LIFT}::DOUBLE, false) AS INTEGER) AS valid
FROM e3 JOIN parents USING (bits) JOIN tq USING (bits), (SELECT total FROM tot WHERE split = 'train') t"""


def wide_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of 15 to 35 items: sets of two and three, rules above the floors on training rows, and what those do on test rows."""
    blocks = _index(spark, sf_dir, max(SIZES))
    sets = bitmaps.frequent_sets(blocks.where("split = 'train'"), (2, 3), SUPPORT)
    both = _both_sides(blocks, sets).where((F.col("support") >= SUPPORT) & (F.col("lift") >= LIFT))
    each = both.withColumn("n_items_used", F.explode(F.array(*map(F.lit, SIZES)))).where(F.array_max("places") < F.col("n_items_used"))
    graded = _evidence(each, ("n_items_used",)).join(each.select("n_items_used", "k", "lift", "test_hit"), ["n_items_used", "k"])
    n = F.col("n_items_used").cast("long")
    found = graded.groupBy("n_items_used").agg(
        F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("test_hit") > 0).alias("n_replayable"), F.count_if(F.col("risk_ratio") >= 1).alias("n_risk"), F.count_if(F.col("q_value") <= 0.05).alias("n_significant"),
        r6(F.median("risk_ratio")).alias("median_risk_ratio"), r6(F.max("lift")).alias("best_lift"),
    )
    return found.select("n_items_used", (n * (n - 1) / 2).cast("long").alias("n_pairs"), (n * (n - 1) * (n - 2) / 6).cast("long").alias("n_triplets"), *found.columns[1:])


WIDE_SWEEP = f"""{_manifest_sql(max(SIZES))}, {_sets_sql(3, _FLOOR)}, u AS ({" UNION ALL ".join(_RULE_SQL.format(source=f"s{k}") for k in (2, 3))}),
v AS (SELECT * FROM u WHERE lift >= {LIFT}::DOUBLE), th AS ({_TEST_SQL.format(source="v")}), tp AS ({_evidence_sql("th")}),
w AS (SELECT n_items_used, tp.*, v.lift FROM tp JOIN v USING (bits), (VALUES {", ".join(f"({n})" for n in SIZES)}) ns(n_items_used) WHERE tp.bits < (1::BIGINT << n_items_used)),
tr AS (SELECT *, row_number() OVER (PARTITION BY n_items_used, p_value IS NOT NULL ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY n_items_used, p_value IS NOT NULL) AS m FROM w),
tq AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1::DOUBLE, min(p_value * m / rk) OVER (PARTITION BY n_items_used, p_value IS NOT NULL ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END AS q_value FROM tr)
SELECT n_items_used, (n_items_used * (n_items_used - 1) // 2)::BIGINT AS n_pairs, (n_items_used * (n_items_used - 1) * (n_items_used - 2) // 6)::BIGINT AS n_triplets, count(*) AS n_rules,
  count(*) FILTER (WHERE hit > 0) AS n_replayable, count(*) FILTER (WHERE risk_ratio >= 1) AS n_risk, count(*) FILTER (WHERE q_value <= 0.05::DOUBLE) AS n_significant,
  round(median(risk_ratio), 6) AS median_risk_ratio, round(max(lift), 6) AS best_lift FROM tq GROUP BY n_items_used"""

NAMES = "wide_rules wide_triplets wide_sweep".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES}
