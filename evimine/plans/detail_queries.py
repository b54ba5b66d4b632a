"""Powertrains, bounds by name, unobserved values, what is said of a rule's axis, and whether a main table is whole, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimine.functions import taxonomy, text
from evimine.operators import audit, evidence, prep
from evimine.plans import rule_queries as R
from evimine.plans.facts import FACTS_SQL, evaluated_sql, facts, read

# Texts that parts are given by turns.
KINDS = ("纯电动", "插电式混合动力", "增程式", None, "不适用")
MOTORS = ("汽油发动机", "柴油发动机", "电动机", None, "汽油发动机-混合动力", "未知", "其他")
FUELS = ("汽油", None, "柴油", "动力电池", "未知", "天然气", None, "油电混合动力", "其他", "汽油", "无")
BATTERIES = {"PROMO": "三元锂", "SMALL": "不适用", "LARGE": "99-未知", "MEDIUM": "磷酸铁锂"}


def _turn(values: tuple[str | None, ...], by: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))


def vehicle_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powertrain flags of every part, from five texts that its key, size and type choose."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    size = F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 4 == 1, "0").when(F.col("p_size") % 4 == 2, "NaN").otherwise("some kWh")
    battery = reduce(lambda c, kv: c.when(F.col("p_type") == kv[0], kv[1]), BATTERIES.items(), F.when(F.lit(False), ""))
    told = text.vehicle_power(_turn(KINDS, "p_partkey"), _turn(MOTORS, "p_partkey"), _turn(FUELS, "p_partkey"), size, battery)
    return part.select("p_partkey", *(c.alias(n) for n, c in told.items()))


def _turn_sql(values: tuple[str | None, ...]) -> str:
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[p_partkey % {len(values)} + 1]"


VEHICLE_POWER = f"""WITH t AS (SELECT p_partkey, p_type, p_size, coalesce({_turn_sql(KINDS)}, '') AS kind, coalesce({_turn_sql(MOTORS)}, '') AS motor, coalesce({_turn_sql(FUELS)}, '') AS fuel FROM part),
f AS (SELECT *, contains(kind, '纯电') OR contains(motor, '电动机') OR contains(fuel, '电池') AS e,
  contains(kind, '插电式混合') OR contains(kind, '增程') OR contains(kind, '混合动力') OR contains(motor, '混合动力') OR contains(fuel, '混合动力') AS h,
  contains(motor, '汽油发动机') OR contains(motor, '柴油发动机') OR contains(fuel, '汽油') OR contains(fuel, '柴油') AS c,
  coalesce(p_size % 4 = 0 AND p_size > 0, false) OR coalesce(p_type IN ('PROMO', 'MEDIUM'), false) AS b FROM t)
SELECT p_partkey, CAST(e AS INTEGER) AS electric, CAST(h AS INTEGER) AS hybrid, CAST(e OR h OR b AS INTEGER) AS new_energy,
  CASE WHEN e THEN '纯电/电驱' WHEN h THEN '混动/增程' WHEN c THEN '燃油' ELSE '未知' END AS powertrain FROM f"""


#: Names that measures are given: bounded, of another spelling, shielded from a bound, without bounds, and of no engineering quantity.
NAMED = {"qty": "V0_Anfang", "price": "Fzg_länge", "disc": "Mue_x", "p_size": "VKREG_no", "s_acctbal": "对方车高", "o_totalprice": "STOSSPX", "tax": "vk_2", "line": "line"}


def name_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and named measure: what its name says of it, and how many values lie outside of its bounds."""
    long = facts(spark, sf_dir).select("split", F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(c).cast("double").alias("value")) for c, n in NAMED.items()))))
    told = long.withColumns(prep.name_bounds(F.col("feature")))
    outside = F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return told.groupBy("split", "feature", "lo", "hi", "is_dimension", "is_engineering").agg(F.count("value").alias("n"), outside.alias("n_outside"))


_EXPECTED = {
    "qty": (0, 250, False, True), "price": (300, 25000, True, True), "disc": (0, 1.2, False, True), "p_size": (None, None, False, True),
    "s_acctbal": (500, 4500, True, True), "o_totalprice": (None, None, False, True), "tax": (0, 250, False, True), "line": (None, None, False, False),
}
_number = lambda v: "NULL::DOUBLE" if v is None else f"{float(v)}::DOUBLE"
NAME_BOUNDS = f"WITH {FACTS_SQL} " + " UNION ALL ".join(
    f"""SELECT split, '{NAMED[c]}' AS feature, {_number(lo)} AS lo, {_number(hi)} AS hi, {str(d).lower()} AS is_dimension, {str(e).lower()} AS is_engineering, count({c}) AS n,
  count(*) FILTER (WHERE {c} < {_number(lo)} OR {c} > {_number(hi)}) AS n_outside FROM facts GROUP BY split"""
    for c, (lo, hi, d, e) in _EXPECTED.items()
)


#: Codes for unknown of sales' raw texts.
CODES = {"total_raw": (), "priority_raw": (5.0,), "client_raw": (0.0, 1.0)}


def _raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = read(spark, sf_dir, "sales")
    total = F.when(F.col("status") == "held", " N/A ").otherwise(F.concat(F.lit("EUR "), F.col("total").cast("decimal(18,2)").cast("string")))
    return sales.select(
        "sale_id", "status", total.alias("total_raw"), F.coalesce(F.concat(F.col("priority").cast("string"), F.lit("-level")), F.lit("99-未知")).alias("priority_raw"),
        F.col("client_id").cast("string").alias("client_raw"),
    )


def unobserved_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale with a flag per raw text that tells nothing."""
    return prep.observed_flags(_raw_sales(spark, sf_dir), CODES, ["sale_id", "status"])


_TOTAL, _PRIORITY, _CLIENT = "total IS NULL OR status = 'held'", "priority IS NULL OR priority = 5", "client_id IS NULL OR client_id IN (0, 1)"
UNOBSERVED_FLAGS = f"""SELECT sale_id, status, CAST(coalesce({_TOTAL}, false) AS INTEGER) AS total_raw, CAST({_PRIORITY} AS INTEGER) AS priority_raw, CAST({_CLIENT} AS INTEGER) AS client_raw FROM sales"""


def unobserved_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prep.unobserved_audit(_raw_sales(spark, sf_dir), CODES, ["status"])
    return found.withColumn("sentinel_rate", F.round("sentinel_rate", 6))


UNOBSERVED_AUDIT = " UNION ALL ".join(
    f"""SELECT status, '{c}' AS feature, count(*) AS n_rows, count(*) FILTER (WHERE {s}) AS n_sentinel, count(*) FILTER (WHERE {m}) AS n_missing_after,
  round(count(*) FILTER (WHERE {s}) / count(*)::DOUBLE, 6) AS sentinel_rate FROM sales GROUP BY status"""
    for c, s, m in (("total_raw", "status = 'held'", _TOTAL), ("priority_raw", _PRIORITY, _PRIORITY), ("client_raw", "client_id IN (0, 1)", _CLIENT))
)


def axis_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mined pair with all that its axis says."""
    mined = R._mined(spark, sf_dir).withColumn("axis", R.axis())
    return mined.select("antecedent", "axis", *(c.alias(n) for n, c in taxonomy.axis_context(F.col("axis")).items()))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BOUNDARY = lambda values, axis: _quoted(values.get(axis, values[""]))
AXIS_CONTEXT = f"""{R.BASE_SQL}, {evaluated_sql("pairs", "train", "e2")}, context(axis, scene, template, mining_boundary, summary_boundary, domain, domain_place) AS (VALUES
  {", ".join(f"({_quoted(a)}, {_quoted(taxonomy.SCENES[a])}, {_quoted(taxonomy.TEMPLATES[a])}, {_BOUNDARY(taxonomy.MINING_BOUNDARIES, a)}, {_BOUNDARY(taxonomy.SUMMARY_BOUNDARIES, a)}, {_quoted(d)}, {i + 1})" for i, (a, d) in enumerate(taxonomy.DOMAINS.items()))}),
m AS (SELECT antecedent, {R.axis_sql()} AS axis FROM e2 WHERE support >= {R.SUPPORT}::DOUBLE AND lift >= {R.LIFT}::DOUBLE)
SELECT m.antecedent, m.axis, scene, template, mining_boundary, summary_boundary, domain, domain_place FROM m JOIN context USING (axis)"""

TABLE_TIERS = (evidence.CORE, evidence.BINARY, evidence.REPLAYABLE)


def table_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the main table of graded pairs is whole, and what one that left out all pairs below a risk ratio of 1.02 would lack."""
    graded = R._graded(spark, sf_dir)
    table = evidence.main_table(graded, TABLE_TIERS)
    parts = {"main table": table, "ratios from 1.02": table.where("risk_ratio >= 1.02")}
    return reduce(DataFrame.unionByName, (audit.table_membership(graded, t, "antecedent", TABLE_TIERS).withColumn("name", F.lit(n)) for n, t in parts.items()))


_IN_TABLE = f"tier IN ({', '.join(map(_quoted, TABLE_TIERS))})"
TABLE_MEMBERSHIP = f"""{R.GRADED_SQL}, c AS (SELECT count(*) FILTER (WHERE {_IN_TABLE}) AS n, count(*) FILTER (WHERE {_IN_TABLE} AND risk_ratio >= 1.02) AS part FROM graded)
SELECT 'main table' AS name, n AS n_expected, n AS n_present, 0::BIGINT AS n_missing, 0::BIGINT AS n_excess, 'PASS' AS status FROM c
UNION ALL SELECT 'ratios from 1.02', n, part, n - part, 0, CASE WHEN part = n THEN 'PASS' ELSE 'FAIL' END FROM c"""

NAMES = "vehicle_power name_bounds unobserved_flags unobserved_audit axis_context table_membership".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
