"""Queries over mined, replayed and graded rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.functions import stats, taxonomy
from evimine.operators import audit, evidence, profile, rules, triplets
from evimine.operators import items as I
from evimine.plans.facts import BASE_SQL, DOMAIN, ITEMS, SEMANTIC, axis_sql, bits_sql, evaluated_sql, facts, hit_sql, observed_sql, replay_sql

AXIS_LABELS = sorted({a for a, _, _ in taxonomy.AXES} | {"mixed_multimechanism"})
SUPPORT, LIFT, TRIPLET_HITS, ITERATIONS = 0.015, 1.0, 40, evidence.ITERATIONS


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _split(spark, sf_dir, name) -> DataFrame:
    return facts(spark, sf_dir).where(F.col("split") == name)


def _mined(spark, sf_dir, sizes=(2,)) -> DataFrame:
    return rules.ranked(rules.mine(_split(spark, sf_dir, "train"), ITEMS, "y", sizes, SUPPORT, LIFT))


def _replayed(spark, sf_dir, sizes=(2,)) -> DataFrame:
    table = I.rule_table(spark, ITEMS, sizes).withColumn("antecedent", rules.joined(F.col("items")))
    return rules.replay(_split(spark, sf_dir, "test"), ITEMS, "y", table)


def _meaning(spark) -> DataFrame:
    return I.local(spark, [(i.name, SEMANTIC.get(i.name, i.name)) for i in ITEMS], "item string, semantic string")


def axis() -> Column:
    """The mechanism axis of a rule."""
    return taxonomy.mechanism_axis(F.col("families"), F.col("items"))


DOMAIN_SQL = "CASE axis " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DOMAIN.items()) + " END"


def domain() -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in DOMAIN.items() for x in kv))
    return pairs[F.col("axis")]


def pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.mine(_split(spark, sf_dir, "train"), ITEMS, "y", (2,), SUPPORT, LIFT)
    return found.select(rules.joined(F.col("items")).alias("antecedent"), "hit", "hit_y",
        *(r6(c).alias(c) for c in ("support", "confidence", "lift", "leverage", "conviction")))


PAIR_RULES = f"""{BASE_SQL}, {evaluated_sql("pairs", "train", "e")}
SELECT antecedent, hit, hit_y, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
  round(support - hit / total::DOUBLE * (positives / total::DOUBLE), 6) AS leverage,
  round(CASE WHEN confidence < 1 THEN (1 - positives / total::DOUBLE) / (1 - confidence) ELSE 'infinity'::DOUBLE END, 6) AS conviction
FROM e WHERE support >= {SUPPORT}::DOUBLE AND lift >= {LIFT}::DOUBLE"""
SCORE_SQL = "(0.42::DOUBLE * lift + 0.32::DOUBLE * confidence + 3.2::DOUBLE * support + 0.07::DOUBLE * len(families) + 0.10::DOUBLE * clarity - 0.035::DOUBLE * n_items)"
ORDER_SQL = f"round({SCORE_SQL}, 12) DESC, round(lift, 12) DESC, antecedent"


def rule_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir, (2, 3, 4)).select("antecedent", r6("score").alias("score"), F.col("candidate_rank").cast("long").alias("candidate_rank"))


RULE_SCORE_RANK = f"""{BASE_SQL}, {evaluated_sql("pairs", "train", "e2")}, {evaluated_sql("triplets", "train", "e3")}, {evaluated_sql("quads", "train", "e4")},
u AS ({" UNION ALL ".join(f"SELECT antecedent, families, clarity, n_items, support, confidence, lift FROM e{n}" for n in (2, 3, 4))})
SELECT antecedent, round({SCORE_SQL}, 6) AS score, row_number() OVER (ORDER BY {ORDER_SQL}) AS candidate_rank
FROM u WHERE support >= {SUPPORT}::DOUBLE AND lift >= {LIFT}::DOUBLE"""


def fpgrowth_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.mine_frequent(_split(spark, sf_dir, "train"), ITEMS, "y", SUPPORT, LIFT, (2, 4))
    return found.select("antecedent", *(r6(c).alias(c) for c in ("support", "confidence", "lift")))


FPGROWTH_RULES = f"""{BASE_SQL}, {evaluated_sql("pairs", "train", "e2")}, {evaluated_sql("triplets", "train", "e3")}, {evaluated_sql("quads", "train", "e4")},
u AS ({" UNION ALL ".join(f"SELECT antecedent, support, confidence, lift FROM e{n}" for n in (2, 3, 4))})
SELECT antecedent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM u WHERE support >= {SUPPORT}::DOUBLE
  AND lift >= {LIFT}::DOUBLE"""


def greedy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = rules.select_diverse(_mined(spark, sf_dir, (2, 3, 4)), axis(), default_cap=3)
    rows = [(f"R{i + 1:02d}", t["antecedent"], t["axis"], t["signature"], round(t["score"], 6)) for i, t in enumerate(taken)]
    return I.local(spark, rows, "rule_id string, antecedent string, axis string, signature string, score double")


_UNION_SQL = " UNION ALL ".join(f"SELECT antecedent, families, clarity, n_items, support, confidence, lift FROM e{n}" for n in (2, 3, 4))
GREEDY_RULES = f"""{BASE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, {evaluated_sql("pairs", "train", "e2")}, {evaluated_sql("triplets", "train", "e3")},
{evaluated_sql("quads", "train", "e4")}, u AS ({_UNION_SQL}),
ranked AS (SELECT antecedent, string_split(antecedent, '||') AS names, {axis_sql()} AS axis, array_to_string(families, '|') AS signature,
  families[1] AS family, {SCORE_SQL} AS score, row_number() OVER (ORDER BY {ORDER_SQL}) AS k
  FROM u WHERE support >= {SUPPORT}::DOUBLE AND lift >= {LIFT}::DOUBLE),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken, []::VARCHAR[][] AS sets, []::VARCHAR[] AS signatures, []::VARCHAR[] AS axes, []::VARCHAR[] AS firsts
  UNION ALL
  SELECT k, CASE WHEN ok THEN list_append(taken, k) ELSE taken END, CASE WHEN ok THEN list_append(sets, names) ELSE sets END,
    CASE WHEN ok THEN list_append(signatures, signature) ELSE signatures END, CASE WHEN ok THEN list_append(axes, axis) ELSE axes END,
    CASE WHEN ok THEN list_append(firsts, family) ELSE firsts END
  FROM (SELECT r.k, w.taken, w.sets, w.signatures, w.axes, w.firsts, r.names, r.signature, r.axis, r.family,
      len(w.taken) < 15 AND NOT list_contains(w.signatures, r.signature) AND len(list_filter(w.axes, lambda x: x = r.axis)) < 3
      AND len(list_filter(w.firsts, lambda x: x = r.family)) < 3 AND len(list_filter(w.sets, lambda x: list_has_all(r.names, x))) = 0 AS ok
    FROM walk w JOIN ranked r ON r.k = w.k + 1)),
last AS (SELECT unnest(taken) AS k, unnest(generate_series(1, len(taken))) AS i FROM walk QUALIFY walk.k = max(walk.k) OVER ())
SELECT printf('R%02d', i) AS rule_id, antecedent, axis, signature, round(score, 6) AS score FROM last JOIN ranked USING (k)"""

REPLAY_COLUMNS = ("test_confidence", "wilson_lower", "wilson_upper", "risk_ratio", "p_value", "q_value")


def rule_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).select("antecedent", "total", "hit", "hit_y", *(r6(c).alias(c) for c in REPLAY_COLUMNS))


RULE_REPLAY = f"""{BASE_SQL}, {replay_sql("pairs", "t")}
SELECT antecedent, total, hit, hit_y, {", ".join(f"round({c}, 6) AS {c}" for c in REPLAY_COLUMNS)} FROM t"""


def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, (3,)).select("antecedent", r6("p_value").alias("p_value"), r6("q_value").alias("q_value"))


BH_QVALUES = f"""{BASE_SQL}, {replay_sql("triplets", "t").replace("continuous, clarity, n_items, duplicate,", "")}
SELECT antecedent, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value FROM t"""


def item_replay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.item_replay(facts(spark, sf_dir), ITEMS)
    return found.select("item", "split", "n_rows", "n_hits", "n_unobserved", "n_unobserved_hits", "low", "high", r6("hit_rate").alias("hit_rate"),
        r6("unobserved_share").alias("unobserved_share"), "status")


ITEM_REPLAY_AUDIT = f"""{BASE_SQL},
  long AS ({" UNION ALL ".join(f"SELECT '{i.name}' AS item, split, {hit_sql(i)} AS hit, NOT {observed_sql(i)} AS unobserved, {f'CAST({i.source} AS DOUBLE)' if i.continuous else 'NULL::DOUBLE'} AS value FROM facts" for i in ITEMS)}),
a AS (SELECT item, split, count(*) AS n_rows, count(*) FILTER (WHERE hit) AS n_hits, count(*) FILTER (WHERE unobserved) AS n_unobserved,
  count(*) FILTER (WHERE hit AND unobserved) AS n_unobserved_hits, min(value) AS low, max(value) AS high FROM long GROUP BY ALL)
SELECT *, round(n_hits / n_rows::DOUBLE, 6) AS hit_rate, round(coalesce(n_unobserved_hits / nullif(n_hits, 0)::DOUBLE, 0), 6) AS unobserved_share,
  CASE WHEN n_hits = 0 THEN 'never hit' WHEN n_unobserved_hits * 2 >= n_hits THEN 'dominated' WHEN n_unobserved_hits * 5 >= n_hits THEN 'warning'
  ELSE 'ok' END AS status FROM a"""


def item_table(spark: SparkSession) -> DataFrame:
    """The manifest as rows: item, family, semantic, source, missing and physical."""
    rows = [(i.name, i.family, SEMANTIC.get(i.name, i.name), i.source, "not_missing_category", 1) for i in ITEMS]
    return I.local(spark, rows, "item string, family string, semantic string, source string, missing string, physical int")


def _triplets(spark, sf_dir) -> DataFrame:
    train = _split(spark, sf_dir, "train")
    seen = I.patterns(train, ITEMS, "y")
    found = I.measures(I.settled(I.evaluate(seen, I.rule_table(spark, ITEMS, (2, 3))))).withColumn("antecedent", rules.joined(F.col("items")))
    return rules.with_parents(found.where("n_items = 3"), found.where("n_items = 2"))


def _valid_triplets(spark, sf_dir) -> DataFrame:
    """Admitted triplets whose antecedent is frequent enough, with their axis."""
    found = triplets.admitted(_triplets(spark, sf_dir), item_table(spark))
    return found.where((F.col("hit") / F.col("total") >= SUPPORT) & (F.col("hit") >= TRIPLET_HITS) & (F.col("lift") >= LIFT)).withColumn("axis", axis())


TRIPLET_COLUMNS = ("support", "confidence", "lift", "best_parent_lift", "incremental_lift")


def triplet_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid_triplets(spark, sf_dir).select("antecedent", "axis", "hit", *(r6(c).alias(c) for c in TRIPLET_COLUMNS))


TRIPLETS_SQL = f"""{BASE_SQL}, {evaluated_sql("pairs", "train", "e2")}, {evaluated_sql("triplets", "train", "e3")},
full3 AS (SELECT e.*, greatest(a.lift, b.lift, c.lift) AS best_parent_lift, e.lift - greatest(a.lift, b.lift, c.lift) AS incremental_lift, {axis_sql('e.')} AS axis
          FROM e3 e JOIN e2 a ON a.bits = e.p1 JOIN e2 b ON b.bits = e.p2 JOIN e2 c ON c.bits = e.p3),
valid AS (SELECT * FROM full3 WHERE duplicate = 0 AND same_source = 0 AND len(families) >= 2 AND list_has_any(families,
  [{", ".join(map(repr, triplets.CORE_FAMILIES))}]) AND hit / total::DOUBLE >= {SUPPORT}::DOUBLE AND hit >= {TRIPLET_HITS}
  AND lift >= {LIFT}::DOUBLE)"""
TRIPLET_CANDIDATES = f"""{TRIPLETS_SQL} SELECT antecedent, axis, hit, {", ".join(f"round({c}, 6) AS {c}" for c in TRIPLET_COLUMNS)} FROM valid"""


def triplet_axis_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(F.round("lift", 12)), F.desc(F.round("confidence", 12)), F.asc("antecedent")]
    capped = rules.axis_capped(_valid_triplets(spark, sf_dir), "axis", order)
    place = F.row_number().over(W.orderBy(*order))
    return capped.select(F.format_string("T%02d", place).alias("rule_id"), "antecedent", "axis", r6("lift").alias("lift"))


TRIPLET_AXIS_CAP = f"""{TRIPLETS_SQL},
capped AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, antecedent) AS k FROM valid),
placed AS (SELECT *, row_number() OVER (ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, antecedent) AS n FROM capped WHERE k <= 3)
SELECT printf('T%02d', n) AS rule_id, antecedent, axis, round(lift, 6) AS lift FROM placed WHERE n <= 20"""


def unconstrained_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _triplets(spark, sf_dir).where((F.col("support") >= SUPPORT) & (F.col("hit") >= TRIPLET_HITS) & (F.col("lift") >= LIFT))
    rank = F.row_number().over(W.orderBy(F.desc(F.round("lift", 12)), F.desc(F.round("confidence", 12)), "antecedent"))
    ranked = found.withColumn("train_rank", rank.cast("long"))
    rule_id = F.format_string("UA%03d", "train_rank").alias("rule_id")
    return ranked.select(rule_id, "antecedent", "hit", r6("lift").alias("lift"), "train_rank", (F.col("train_rank") <= 20).alias("in_top20"),
        (F.col("train_rank") <= 50).alias("in_top50"))


UNCONSTRAINED_TRIPLETS = f"""{TRIPLETS_SQL},
a AS (SELECT *, row_number() OVER (ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, antecedent) AS train_rank FROM full3
  WHERE support >= {SUPPORT}::DOUBLE AND hit >= {TRIPLET_HITS} AND lift >= {LIFT}::DOUBLE)
SELECT printf('UA%03d', train_rank) AS rule_id, antecedent, hit, round(lift, 6) AS lift, train_rank, train_rank <= 20 AS in_top20, train_rank <= 50 AS in_top50 FROM a"""


def arm_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.mine_frequent(_split(spark, sf_dir, "train"), ITEMS, "y", SUPPORT, LIFT, (3, 3))
    place = F.row_number().over(W.orderBy(F.desc(F.round("lift", 12)), F.desc(F.round("confidence", 12)), "antecedent"))
    return found.select(F.format_string("ARM%03d", place).alias("rule_id"), "antecedent", r6("support").alias("support"), r6("lift").alias("lift"))


ARM_TRIPLETS = f"""{BASE_SQL}, {evaluated_sql("triplets", "train", "e")}
SELECT printf('ARM%03d', row_number() OVER (ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, antecedent)) AS rule_id, antecedent, round(support, 6) AS support, round(lift, 6) AS lift FROM e WHERE support >= {SUPPORT}::DOUBLE AND lift >= {LIFT}::DOUBLE"""


def topk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = unconstrained_triplets(spark, sf_dir).select("antecedent", "train_rank")
    both = ranked.join(_replayed(spark, sf_dir, (3,)), "antecedent")
    each = both.select("*", F.explode(F.array(F.lit(20), F.lit(50))).alias("k")).where(F.col("train_rank") <= F.col("k"))
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("risk_ratio") >= 1).alias("n_risk"),
        F.count_if(F.col("p_value") <= 0.05).alias("n_nominal"), r6(F.median("risk_ratio")).alias("median_risk_ratio"))


TOPK_SUMMARY = f"""{TRIPLETS_SQL}, {replay_sql("triplets", "t").replace("continuous, clarity, n_items, duplicate,", "")},
a AS (SELECT antecedent, row_number() OVER (ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, antecedent) AS train_rank FROM full3
  WHERE support >= {SUPPORT}::DOUBLE AND hit >= {TRIPLET_HITS} AND lift >= {LIFT}::DOUBLE)
SELECT k, count(*) AS n_rules, count(*) FILTER (WHERE risk_ratio >= 1) AS n_risk, count(*) FILTER (WHERE p_value <= 0.05::DOUBLE) AS n_nominal,
  round(median(risk_ratio), 6) AS median_risk_ratio
FROM a JOIN t USING (antecedent), (VALUES (20), (50)) ks(k) WHERE train_rank <= k GROUP BY k"""


def _pair_table(spark) -> DataFrame:
    return I.rule_table(spark, ITEMS, (2,)).withColumn("antecedent", rules.joined(F.col("items")))


def group_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.bootstrap(_split(spark, sf_dir, "train"), ITEMS, "y", "grp", _pair_table(spark), ITERATIONS)
    return found.select("antecedent", "recurrent", r6("recurrence").alias("recurrence"))


_M = evidence.DRAW_MODULUS


def bootstrap_sql(rules: str) -> str:
    return f"""groups AS (SELECT grp, bits, count(*) AS n, sum(y) AS y FROM hits WHERE split = 'train' GROUP BY grp, bits),
seeds AS (SELECT bits, n, y, ('0x' || substr(md5(coalesce(CAST(grp AS VARCHAR), '')), 1, 8))::BIGINT AS s1,
  ('0x' || substr(md5(coalesce(CAST(grp AS VARCHAR), '')), 9, 8))::BIGINT AS s2 FROM groups),
weights AS (SELECT bits, i AS iteration, n, y, ((s1 + i * s2) % {_M}) / {float(_M)}::DOUBLE AS u FROM seeds, range({ITERATIONS}) d(i)),
drawn AS (SELECT iteration, bits, sum(n * w) AS n, sum(y * w) AS y FROM (SELECT *,
  {" + ".join(f"CAST(u >= {p!r}::DOUBLE AS INTEGER)" for p in evidence.POISSON)} AS w FROM weights) WHERE w > 0 GROUP BY iteration, bits),
tot AS (SELECT iteration, sum(n) AS total, sum(y) AS positives FROM drawn GROUP BY iteration),
rep AS (SELECT p.antecedent, t.iteration, coalesce(sum(d.n) FILTER (WHERE (d.bits & p.bits) = p.bits), 0) AS hit,
  coalesce(sum(d.y) FILTER (WHERE (d.bits & p.bits) = p.bits), 0) AS hit_y, any_value(t.total) AS total, any_value(t.positives) AS positives
        FROM {rules} p, drawn d JOIN tot t USING (iteration) GROUP BY p.antecedent, t.iteration),
boot AS (SELECT antecedent, count(*) FILTER (WHERE hit / total::DOUBLE >= 0.8::DOUBLE * 0.015::DOUBLE AND hit_y / nullif(hit,
  0)::DOUBLE / (positives / total::DOUBLE) >= 1) AS recurrent, count(*) AS n FROM rep WHERE total >= 20 GROUP BY antecedent)"""


BOOTSTRAP_SQL = bootstrap_sql("pairs")
GROUP_BOOTSTRAP = f"""{BASE_SQL}, {BOOTSTRAP_SQL} SELECT antecedent, recurrent, round(recurrent / n::DOUBLE, 6) AS recurrence FROM boot"""


def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.sensitivity(_split(spark, sf_dir, "test"), ITEMS, "y", _pair_table(spark))
    return found.select("antecedent", "hit_min", *(r6(c).alias(c) for c in ("lift_min", "lift_max", "confidence_min")))


def sensitivity_sql(rules: str) -> str:
    return "moved AS (" + " UNION ALL ".join(f"SELECT {i} AS delta, y, {bits_sql(f'(1 + {d!r}::DOUBLE)') if d else bits_sql()} AS bits FROM facts WHERE split = 'test'" for i, d in enumerate(evidence.DELTAS)) + f"""),
mt AS (SELECT delta, count(*) AS total, sum(y) AS positives FROM moved GROUP BY delta),
me AS (SELECT p.antecedent, m.delta, count(*) FILTER (WHERE (m.bits & p.bits) = p.bits) AS hit,
  coalesce(sum(m.y) FILTER (WHERE (m.bits & p.bits) = p.bits), 0) AS hit_y, any_value(mt.total) AS total, any_value(mt.positives) AS positives
       FROM {rules} p, moved m JOIN mt USING (delta) WHERE p.continuous = 1 GROUP BY p.antecedent, m.delta),
sens AS (SELECT antecedent, min(hit) AS hit_min, min(hit_y / nullif(hit, 0)::DOUBLE / (positives / total::DOUBLE)) AS lift_min,
  max(hit_y / nullif(hit, 0)::DOUBLE / (positives / total::DOUBLE)) AS lift_max, min(hit_y / nullif(hit, 0)::DOUBLE) AS confidence_min FROM me
  GROUP BY antecedent)"""


SENSITIVITY_SQL = sensitivity_sql("pairs")
THRESHOLD_SENSITIVITY = f"""{BASE_SQL}, {SENSITIVITY_SQL}
SELECT antecedent, hit_min, round(lift_min, 6) AS lift_min, round(lift_max, 6) AS lift_max, round(confidence_min, 6) AS confidence_min FROM pairs
  LEFT JOIN sens USING (antecedent)"""


def _moved(spark, sf_dir) -> DataFrame:
    """Patterns of test rows as thresholds move: at most 2**10 for each delta, as there are ten items."""
    return I.settled(evidence.moved_patterns(_split(spark, sf_dir, "test"), ITEMS, "y"))


def unmoved(patterns: DataFrame) -> DataFrame:
    return patterns.where(F.col("delta") == evidence.DELTAS.index(0.0)).select("bits", "n", "y")


def _graded(spark, sf_dir) -> DataFrame:
    """Pairs with all evidence, graded by the ladder's own limits; training and test rows are scanned once each."""
    test = _moved(spark, sf_dir)
    seen = rules.replay_of(unmoved(test), _pair_table(spark)).withColumn("resolved", F.lit(True))
    boot = evidence.bootstrap(_split(spark, sf_dir, "train"), ITEMS, "y", "grp", _pair_table(spark), ITERATIONS).select("antecedent", "recurrence")
    moved = evidence.sensitivity_of(test, _pair_table(spark)).select("antecedent", "hit_min", "lift_min")
    return seen.join(boot, "antecedent").join(moved, "antecedent").withColumns({"tier": evidence.tier(), "axis": axis()})


GRADED_SQL = f"""{BASE_SQL}, {replay_sql("pairs", "t")}, {BOOTSTRAP_SQL}, {SENSITIVITY_SQL},
ev AS (SELECT t.*, boot.recurrent / boot.n::DOUBLE AS recurrence, hit_min, lift_min, coalesce(t.hit >= 1 AND q_value <= 0.05::DOUBLE
  AND risk_ratio >= 1, false) AS stat, {axis_sql('t.')} AS axis
       FROM t JOIN boot USING (antecedent) LEFT JOIN sens USING (antecedent)),
graded AS (SELECT *, CASE WHEN stat AND recurrence >= 0.95::DOUBLE AND hit >= 5 AND continuous = 1 AND coalesce(lift_min >= 1, false) THEN 'core-confirmed'
  WHEN stat AND recurrence >= 0.95::DOUBLE AND hit >= 5 AND continuous = 0 THEN 'binary-stable confirmed' WHEN stat THEN 'statistically confirmed'
  ELSE 'replayable' END AS tier FROM ev)"""


def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("antecedent", "tier", evidence.threshold_stable().alias("threshold_stable"),
        evidence.reporting_role(F.col("tier")).alias("role"))


EVIDENCE_TIERS = f"""{GRADED_SQL} SELECT antecedent, tier, CAST(coalesce(continuous = 1 AND lift_min >= 1 AND hit_min >= 5, false) AS INTEGER) AS threshold_stable,
  CASE WHEN tier IN ('core-confirmed', 'binary-stable confirmed') THEN 'main text' WHEN tier = 'statistically confirmed' THEN 'monitoring'
  ELSE 'supplement' END AS role FROM graded"""


def physical_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir)
    duplicated = audit.semantic_duplicates(graded, _meaning(spark)).select("antecedent", F.lit(1).alias("duplicate")).distinct()
    each = graded.join(duplicated, "antecedent", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(0)))
    return each.select("antecedent", "duplicate", evidence.physical_tier(F.col("tier"), F.col("duplicate") == 0, only_confirmed=False).alias("physical_tier"))


PHYSICAL_TIERS = f"""{GRADED_SQL} SELECT antecedent, duplicate, CASE WHEN duplicate = 1 THEN 'data-availability-or-redundancy ' || tier ELSE tier END AS physical_tier FROM graded"""


def axis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.axis_summary(_graded(spark, sf_dir))
    return found.withColumns({c: r6(c) for c in ("median_risk_ratio", "best_risk_ratio")})


AXIS_SUMMARY = f"""{GRADED_SQL} SELECT axis, count(*) AS n_rules,
  {", ".join(f"count(*) FILTER (WHERE tier = '{t}') AS {n}" for n, t in (("n_core", evidence.CORE), ("n_binary", evidence.BINARY), ("n_statistical", evidence.STATISTICAL), ("n_replayable", evidence.REPLAYABLE)))},
  round(median(risk_ratio), 6) AS median_risk_ratio, round(max(risk_ratio), 6) AS best_risk_ratio FROM graded GROUP BY axis"""


def universe_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = I.local(spark, [(f,) for f in AXIS_LABELS], "axis string")
    mined = _mined(spark, sf_dir).withColumn("axis", axis())
    return evidence.spine(axes, {"n_universe": mined, "n_top": mined.where("candidate_rank <= 5"), "n_triplets": _valid_triplets(spark, sf_dir)})


UNIVERSE_SPINE = f"""{TRIPLETS_SQL}, mined AS (SELECT {axis_sql()} AS axis, row_number() OVER (ORDER BY {ORDER_SQL}) AS k FROM e2
  WHERE support >= {SUPPORT}::DOUBLE AND lift >= {LIFT}::DOUBLE),
axes(axis) AS (VALUES {", ".join(f"('{a}')" for a in AXIS_LABELS)})
SELECT axis, (SELECT count(*) FROM mined m WHERE m.axis = axes.axis) AS n_universe, (SELECT count(*) FROM mined m WHERE m.axis = axes.axis
  AND k <= 5) AS n_top, (SELECT count(*) FROM valid v WHERE v.axis = axes.axis) AS n_triplets FROM axes"""


def domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.roll_up(_graded(spark, sf_dir), domain())


DOMAIN_ROLLUP = f"""{GRADED_SQL} SELECT {DOMAIN_SQL} AS domain, count(*) AS n_rules,
  min_by(tier, CASE tier {" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(evidence.TIER_ORDER))} END) AS best_tier, string_agg(antecedent, '; '
  ORDER BY antecedent) AS rules FROM graded GROUP BY 1"""


def family_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.family_distribution(_mined(spark, sf_dir, (2, 3)).withColumn("n_items", F.col("n_items").cast("long")), ["n_items"])


FAMILY_DISTRIBUTION = f"""{TRIPLETS_SQL}, u AS (SELECT n_items, unnest(families) AS family FROM (SELECT n_items, families, support, lift FROM e2
  UNION ALL SELECT n_items, families, support, lift FROM e3) WHERE support >= {SUPPORT}::DOUBLE AND lift >= {LIFT}::DOUBLE),
c AS (SELECT n_items, family, count(*) AS n FROM u GROUP BY ALL)
SELECT n_items::BIGINT AS n_items, string_agg(family || ':' || n, '||' ORDER BY family || ':' || n) AS distribution, count(*) AS n_families FROM c GROUP BY n_items"""


def herfindahl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.herfindahl(_mined(spark, sf_dir, (2, 3)).withColumn("axis", axis()).withColumn("n_items", F.col("n_items").cast("long")), ["n_items"], "axis")
    return found.withColumn("herfindahl", r6("herfindahl"))


HERFINDAHL = f"""{TRIPLETS_SQL}, u AS (SELECT n_items, {axis_sql()} AS axis FROM (SELECT n_items, antecedent, families, support, lift FROM e2
  UNION ALL SELECT n_items, antecedent, families, support, lift FROM e3) WHERE support >= {SUPPORT}::DOUBLE AND lift >= {LIFT}::DOUBLE),
c AS (SELECT n_items, axis, count(*) AS n FROM u GROUP BY ALL), s AS (SELECT n_items, n / sum(n) OVER (PARTITION BY n_items)::DOUBLE AS share FROM c)
SELECT n_items::BIGINT AS n_items, round(sum(share * share), 6) AS herfindahl, count(*) AS n_categories FROM s GROUP BY n_items"""


def semantic_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined pairs and triplets that say one thing twice."""
    return audit.semantic_duplicates(_mined(spark, sf_dir, (2, 3)), _meaning(spark))


SEMANTIC_DUPLICATES = f"""{BASE_SQL}, {evaluated_sql("pairs", "train", "e2")}, {evaluated_sql("triplets", "train", "e3")},
u AS ({" UNION ALL ".join(f"SELECT antecedent FROM e{n} WHERE support >= {SUPPORT}::DOUBLE AND lift >= {LIFT}::DOUBLE" for n in (2, 3))}), each AS (SELECT antecedent,
  unnest(string_split(antecedent, '||')) AS name FROM u)
SELECT antecedent, semantic, count(*) AS n_items, string_agg(name, '||' ORDER BY name) AS duplicated FROM each JOIN items USING (name)
  GROUP BY antecedent, semantic HAVING count(*) > 1"""


def usage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = _mined(spark, sf_dir).select(F.explode("items").alias("feature"), "candidate_rank")
    base = I.local(spark, [(i.name, i.family) for i in ITEMS], "feature string, family string")
    unknown = audit.item_replay(facts(spark, sf_dir), ITEMS).groupBy(F.col("item").alias("feature")).agg(F.sum("n_unobserved").alias("n_unobserved"))
    return audit.usage(base.join(unknown, "feature"), {"in_universe": mined, "in_top": mined.where("candidate_rank <= 5")})


USAGE_AUDIT = f"""{TRIPLETS_SQL}, mined AS (SELECT bits, row_number() OVER (ORDER BY {ORDER_SQL}) AS k FROM e2 WHERE support >= {SUPPORT}::DOUBLE
  AND lift >= {LIFT}::DOUBLE),
un AS ({" UNION ALL ".join(f"SELECT '{i.name}' AS name, count(*) FILTER (WHERE NOT {observed_sql(i)}) AS n_unobserved FROM facts" for i in ITEMS)})
SELECT name AS feature, family, n_unobserved, CAST(EXISTS (SELECT 1 FROM mined m WHERE (m.bits & i.bit) > 0) AS INTEGER) AS in_universe,
  CAST(EXISTS (SELECT 1 FROM mined m WHERE (m.bits & i.bit) > 0 AND k <= 5) AS INTEGER) AS in_top
FROM items i JOIN un USING (name)"""


def size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules found by the first N items, N = 4, 6, 8, 10."""
    seen = I.patterns(_split(spark, sf_dir, "train"), ITEMS, "y")
    found = I.measures(I.settled(I.evaluate(seen, I.rule_table(spark, ITEMS, (2, 3))))).where((F.col("support") >= SUPPORT) & (F.col("lift") >= LIFT))
    each = found.select("n_items", "bits", "lift",
        F.explode(F.array(*map(F.lit, (4, 6, 8, 10)))).alias("n_features")).where(F.col("bits") < F.pow(F.lit(2.0), F.col("n_features")))
    return each.groupBy("n_features").agg(F.count_if(F.col("n_items") == 2).alias("n_pairs"), F.count_if(F.col("n_items") == 3).alias("n_triplets"),
        r6(F.max("lift")).alias("best_lift"))


SIZE_SWEEP = f"""{TRIPLETS_SQL}, u AS (SELECT n_items, bits, lift FROM (SELECT n_items, bits, support, lift FROM e2 UNION ALL SELECT n_items, bits,
  support, lift FROM e3) WHERE support >= {SUPPORT}::DOUBLE AND lift >= {LIFT}::DOUBLE)
SELECT n AS n_features, count(*) FILTER (WHERE n_items = 2) AS n_pairs, count(*) FILTER (WHERE n_items = 3) AS n_triplets, round(max(lift),
  6) AS best_lift FROM u, (VALUES (4), (6), (8), (10)) s(n) WHERE bits < (1 << n) GROUP BY n"""

NAMES = (
    "pair_rules rule_score_rank fpgrowth_rules greedy_rules rule_replay bh_qvalues item_replay_audit triplet_candidates triplet_axis_cap unconstrained_triplets arm_triplets topk_summary "
    "group_bootstrap threshold_sensitivity evidence_tiers physical_tiers axis_summary universe_spine domain_rollup family_distribution herfindahl semantic_duplicates usage_audit size_sweep"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
