"""Role binding: which table and column plays which part, once for Spark and once for SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimine.functions import taxonomy
from evimine.operators.items import Item
from evimine.operators.prep import split_by_group
from evimine.sources.scratch import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice"]

# Names speak the taxonomy, which gives every item its family and every rule its axis.
ITEMS = [
    Item("FEATURE_AGE___GT_5000", "s_acctbal", ">", 5000.0, "age"),
    Item("FRICTION___GT_0_05", "disc", ">", 0.05, "road_surface", (0.0,)),
    Item("IMPACT_SPEED___GT_60000", "price", ">", 60000.0, "speed_vk"),
    Item("INITIAL_SPEED___GT_30", "qty", ">", 30.0, "speed_v0", (), "domain"),
    Item("INITIAL_SPEED___LE_10", "qty", "<=", 10.0, "speed_v0", (), "exploratory_low"),
    Item("VEHICLE_LENGTH___LE_20", "p_size", "<=", 20, "vehicle_size"),
    Item("ROAD_TYPE_F", "o_orderstatus", "==", "F", "road_type"),
    Item("NIGHT_SHARE___GT_0_04", "tax", ">", 0.04, "light", (0.0,)),
    Item("AEB_URGENT", "o_orderpriority", "==", "1-URGENT", "safety"),
    Item("COLLISION_TYPE_O", "l_linestatus", "==", "O", "crash_type"),
]
SEMANTIC = {
    "INITIAL_SPEED___GT_30": "volume", "INITIAL_SPEED___LE_10": "volume", "IMPACT_SPEED___GT_60000": "value", "FRICTION___GT_0_05": "value",
    "ROAD_TYPE_F": "order_state", "AEB_URGENT": "order_state",
}
DOMAIN = {
    "speed_energy": "speed", "vulnerability_speed": "people", "vehicle_geometry_vulnerability": "people", "road_speed_environment": "speed",
        "vehicle_geometry_interaction": "vehicles",
    "lighting_visibility": "roads", "surface_weather_friction": "roads", "safety_assistance": "vehicles", "crash_configuration": "conflicts",
        "mixed_multimechanism": "mixed",
}
BOUNDS = {"qty": (5.0, 45.0), "price": (2000.0, 90000.0), "disc": (0.01, 0.09), "p_size": (2.0, 45.0), "s_acctbal": (0.0, 9000.0), "o_totalprice": (5000.0, 450000.0)}
NUMBERS = list(BOUNDS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
            "l_linestatus", "l_returnflag", "l_shipdate",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lineitem per row with the attributes of its order, part and supplier; sides are broadcast only if the planner's size check says so."""
    line = _line(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("grp"), "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_type", "p_brand")
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    rows = line.join(part, "l_partkey", "left").join(supplier, "l_suppkey", "left").join(orders, "grp", "left")
    return rows.withColumn("split", split_by_group(F.col("grp")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of facts with the columns that lineitem has: a row as often as its keys occur in the other tables, at least once.

    Keys that occur more than once are looked for first; where there are none, nothing is joined.
    """
    line = _line(spark, sf_dir)
    for key, table, column in (("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey"), ("grp", "orders", "o_orderkey")):
        counted = read(spark, sf_dir, table).where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias("_n"))
        again = stored(counted.where("_n > 1"))
        if not again.isEmpty():
            copies = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long")))).alias("_copy")
            line = line.join(again, key, "left").select(*line.columns, copies).drop("_copy")
    return line.withColumn("split", split_by_group(F.col("grp")))


FACTS_SQL = """facts AS (
  SELECT l_orderkey AS grp, l_linenumber AS line, l_partkey, l_suppkey, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity AS qty,
         l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_linestatus, l_returnflag, l_shipdate, o_orderstatus, o_orderpriority,
         o_totalprice, o_orderdate, p_size, p_type, p_brand, s_acctbal, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


def _literal(v: float | str) -> str:
    return f"'{v}'" if isinstance(v, str) else f"{float(v)!r}::DOUBLE"


def observed_sql(item: Item) -> str:
    codes = "".join(f" AND {item.source} <> {_literal(c)}" for c in item.unobserved)
    return f"({item.source} IS NOT NULL{codes})"


def hit_sql(item: Item, scale: str = "") -> str:
    edge = f"({_literal(item.threshold)} * {scale})" if scale and item.continuous else _literal(item.threshold)
    return f"coalesce({observed_sql(item)} AND {item.source} {'=' if item.operator == '==' else item.operator} {edge}, false)"


def bits_sql(scale: str = "") -> str:
    return " + ".join(f"CASE WHEN {hit_sql(i, scale)} THEN {1 << n}::BIGINT ELSE 0::BIGINT END" for n, i in enumerate(ITEMS))


ITEMS_SQL = "items(name, bit, family, clarity, continuous, semantic, source) AS (VALUES " + ", ".join(
    f"('{i.name}', {1 << n}::BIGINT, '{i.family}', {i.clarity}::DOUBLE, {int(i.continuous)}, '{SEMANTIC.get(i.name, i.name)}', '{i.source}')" for n, i in enumerate(ITEMS)
) + ")"
RULES_SQL = """pairs AS (
  SELECT a.name || '||' || b.name AS antecedent, a.bit + b.bit AS bits, list_sort(list_distinct([a.family, b.family])) AS families,
         (a.clarity + b.clarity) / 2 AS clarity, greatest(a.continuous, b.continuous) AS continuous, 2 AS n_items,
         CAST(a.semantic = b.semantic AS INTEGER) AS duplicate
  FROM items a JOIN items b ON a.name < b.name),
triplets AS (
  SELECT a.name || '||' || b.name || '||' || c.name AS antecedent, a.bit + b.bit + c.bit AS bits, list_sort(list_distinct([a.family, b.family, c.family])) AS families,
         (a.clarity + b.clarity + c.clarity) / 3 AS clarity, greatest(a.continuous, b.continuous, c.continuous) AS continuous, 3 AS n_items,
         CAST(a.semantic = b.semantic OR a.semantic = c.semantic OR b.semantic = c.semantic AS INTEGER) AS duplicate,
         CAST(a.source = b.source OR a.source = c.source OR b.source = c.source AS INTEGER) AS same_source,
         a.bit + b.bit AS p1, a.bit + c.bit AS p2, b.bit + c.bit AS p3
  FROM items a JOIN items b ON a.name < b.name JOIN items c ON b.name < c.name),
quads AS (
  SELECT a.name || '||' || b.name || '||' || c.name || '||' || d.name AS antecedent, a.bit + b.bit + c.bit + d.bit AS bits,
  list_sort(list_distinct([a.family, b.family, c.family, d.family])) AS families,
         (a.clarity + b.clarity + c.clarity + d.clarity) / 4 AS clarity, 4 AS n_items
  FROM items a JOIN items b ON a.name < b.name JOIN items c ON b.name < c.name JOIN items d ON c.name < d.name)"""


def axis_sql(table: str = "") -> str:
    """The mechanism axis of a rule, as taxonomy.mechanism_axis, from its columns families and antecedent."""
    text, families = f"upper(replace({table}antecedent, '||', ' '))", f"{table}families"
    holds = {}
    for key, (own, words) in taxonomy.TRAITS.items():
        found = f"regexp_matches({text}, '{'|'.join(map(re.escape, words))}')"
        holds[key] = f"({found} OR list_has_any({families}, [{', '.join(map(repr, own))}]))" if own else found
    holds["age"] = f"({holds['age']} OR regexp_matches(regexp_replace({text}, '(^|_)USAGE(_|$)', ' ', 'g'), '(^|_)AGE(_|$)'))"
    holds["sex"] = f"({holds['sex']} OR regexp_matches({text}, '(^|[_ ])SEX([_ ]|$)'))"
    holds["speed"] = f"({holds['v0']} OR {holds['vk']})"
    whens = (f"WHEN {' AND '.join([*(holds[t] for t in needs), *(f'NOT {holds[t]}' for t in lacks)])} THEN '{label}'" for label, needs, lacks in taxonomy.AXES)
    return f"CASE {' '.join(whens)} ELSE 'mixed_multimechanism' END"


ROWS_SQL = f"hits AS (SELECT grp, split, y, {bits_sql()} AS bits FROM facts)"
BASE_SQL = f"WITH {FACTS_SQL}, {ITEMS_SQL}, {RULES_SQL}, {ROWS_SQL}"


def evaluated_sql(rules: str, split: str, name: str) -> str:
    """A CTE with support, confidence and lift of every rule over the rows of a split."""
    return f"""{name} AS (
  SELECT r.*, t.total, t.positives, h.hit, h.hit_y, h.hit_y / t.total::DOUBLE AS support, h.hit_y / nullif(h.hit, 0)::DOUBLE AS confidence,
         h.hit_y / nullif(h.hit, 0)::DOUBLE / (t.positives / t.total::DOUBLE) AS lift
  FROM (SELECT q.antecedent AS a, count(h.bits)::BIGINT AS hit, coalesce(sum(h.y), 0)::BIGINT AS hit_y FROM {rules} q LEFT JOIN (SELECT * FROM hits
  WHERE split = '{split}') h ON (h.bits & q.bits) = q.bits GROUP BY q.antecedent) h
  JOIN {rules} r ON r.antecedent = h.a, (SELECT count(*)::BIGINT AS total, sum(y)::BIGINT AS positives FROM hits WHERE split = '{split}') t)"""


EVIDENCE_SQL = """SELECT antecedent, bits, families, continuous, clarity, n_items, duplicate, hit, hit_y, total, positives,
  confidence AS test_confidence, lift AS risk_ratio,
  CASE WHEN hit > 0 THEN greatest(0::DOUBLE,
  (p + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)) END AS wilson_lower,
  CASE WHEN hit > 0 THEN least(1::DOUBLE,
  (p + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)) END AS wilson_upper,
  CASE WHEN hit > 0 THEN least(1::DOUBLE, list_sum(list_transform(range(hit_y, hit + 1),
  lambda i: exp(lgamma(hit + 1) - lgamma(i + 1) - lgamma(hit - i + 1) + i * ln(b) + (hit - i) * ln(1 - b))))) END AS p_value
  FROM (SELECT *, hit_y / nullif(hit, 0)::DOUBLE AS p, hit::DOUBLE AS n, positives / total::DOUBLE AS b FROM {source})"""


def replay_sql(rules: str, name: str) -> str:
    """CTEs with test evidence of all rules, q-values included."""
    evidence = EVIDENCE_SQL.format(source=f"{name}_seen")
    return f"""{evaluated_sql(rules, "test", name + "_seen")}, {name}_p AS ({evidence}),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY p_value IS NOT NULL ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY p_value IS NOT NULL) AS m FROM {name}_p),
{name} AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1::DOUBLE, min(p_value * m / rk) OVER (PARTITION BY p_value IS NOT NULL
  ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END AS q_value FROM {name}_r)"""
