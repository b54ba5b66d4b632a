"""Ranks, q-values, information and correlations over tables of any size, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimine.functions import stats
from evimine.operators import extra_trees, folds, gram, neighbours, profile, ranks, wrapper
from evimine.plans.facts import FACTS_SQL, NUMBERS, facts, read
from evimine.plans.table_queries import FOLDS_SQL, LONG_SQL, r6

WITH = f"WITH {FACTS_SQL}"


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every order among those of its priority, by total price."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    found = ranks.ranked(orders, "o_totalprice", ["o_orderpriority"])
    return found.select("o_orderkey", F.col("rank").cast("long").alias("rank"), F.round("points", 9).alias("points"))


ORDER_RANKS = """SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN rank() OVER w END AS rank,
  CASE WHEN o_totalprice IS NOT NULL THEN round((count(o_totalprice) OVER (PARTITION BY o_orderpriority) - rank() OVER w + 1) / (count(o_totalprice) OVER (PARTITION BY o_orderpriority))::DOUBLE, 9) END AS points
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST)"""


def part_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the lines of a part are returned more often than all are: an exact test per part, with q-values over all parts."""
    f = facts(spark, sf_dir).select("l_partkey", "y")
    tested = f.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_y"))
    base = tested.agg((F.sum("n_y") / F.sum("n")).alias("rate"))
    scored = tested.crossJoin(F.broadcast(base)).withColumn("p_value", F.round(stats.binomial_tail(F.col("n_y"), F.col("n"), F.col("rate")), 12))
    return ranks.step_up(scored, "p_value", "q_value").select("l_partkey", "n", "n_y", r6("p_value").alias("p_value"), r6("q_value").alias("q_value"))


PART_ENRICHMENT = f"""{WITH}, t AS (SELECT l_partkey, count(*)::BIGINT AS n, sum(y)::BIGINT AS n_y FROM facts GROUP BY l_partkey), b AS (SELECT sum(n_y) / sum(n)::DOUBLE AS rate FROM t),
p AS (SELECT l_partkey, n, n_y, round(least(1::DOUBLE, list_sum(list_transform(range(n_y, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(rate) + (n - i) * ln(1 - rate))))), 12) AS p_value FROM t, b),
r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS rk, count(*) OVER () AS m FROM p)
SELECT l_partkey, n, n_y, round(p_value, 6) AS p_value, round(least(1::DOUBLE, min(p_value * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM r"""


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of whole orders with like shares of rows and returns."""
    f = facts(spark, sf_dir).select("grp", "y")
    placed = f.join(folds.assign(f, "grp", "y"), "grp")
    return placed.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("grp").alias("n_groups"), F.sum("y").alias("n_y"))


STRATIFIED_FOLDS = f"""{WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, {FOLDS_SQL}
SELECT fold::INTEGER AS fold, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, sum(facts.y)::BIGINT AS n_y FROM facts JOIN folds USING (grp) GROUP BY fold"""


def neighbour_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each number says of the label, from nearest neighbours among training rows."""
    long = profile.long_form(facts(spark, sf_dir).where("split = 'train'"), ["y"], NUMBERS).select("feature", "value", F.col("y").alias("label"))
    return neighbours.mutual_information(long).select("feature", r6("information").alias("information"))


_INFORMATION = neighbours.oracle("(SELECT feature, value, y AS label FROM long WHERE split = 'train')")
NEIGHBOUR_INFORMATION = f"{WITH}, {LONG_SQL}, found AS ({_INFORMATION}) SELECT feature, round(information, 6) AS information FROM found"

def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation of every pair of numbers, from one scan."""
    pairs = gram.correlations(facts(spark, sf_dir), [*NUMBERS, "tax", "line"])
    names = F.array(*(F.lit(n) for n in [*NUMBERS, "tax", "line"]))
    return pairs.select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), F.round("corr", 6).alias("corr"))


_COLUMNS = [*NUMBERS, "tax", "line"]
CORRELATION_PAIRS = f"{WITH} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(coalesce({a}, 0), coalesce({b}, 0)), 6) AS corr FROM facts" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :])


def _with_flag(spark, sf_dir) -> DataFrame:
    f = facts(spark, sf_dir).where("split = 'train'").select("grp", "y", *NUMBERS, "tax", "l_returnflag")
    return f.withColumn("flag_n", (F.col("l_returnflag") == "N").cast("int"))


def wrapper_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subset of numbers that a wolf search finds best for a linear model; whoever has the flag needs nothing else."""
    features = [*NUMBERS, "flag_n"]
    m = wrapper.matrix(_with_flag(spark, sf_dir), features, "y", "grp")
    best, value, recurrent = wrapper.search(m, len(features), wolves=8, iterations=5)
    rows = [(f, int(i in best), float(recurrent[i]), float(value)) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, chosen int, recurrence double, value double")


def random_split_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each number to extremely randomised trees."""
    forest = extra_trees.grow(_with_flag(spark, sf_dir), [*NUMBERS, "tax", "flag_n"], "y", trees=50, depth=6)
    return spark.createDataFrame([(f, float(v)) for f, v in forest.importances().items()], "feature string, importance double")


NAMES = "correlation_pairs wrapper_search random_split_importance order_ranks part_enrichment stratified_folds neighbour_information".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
