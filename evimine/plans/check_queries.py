"""Lineage and checks over the given tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimine.operators import lineage, prep, profile, rules, screening
from evimine.operators import items as I
from evimine.plans.facts import BOUNDS, FACTS_SQL, ITEMS, NUMBERS, facts, read
from evimine.plans.rule_queries import LIFT, SUPPORT, _pair_table
from evimine.sources.scratch import FINE, stored

#: Name and condition, in words that both engines read, of every row of a table.
ROWS = {
    "facts": {
        "label_is_binary": "y IN (0, 1)", "order_named": "grp IS NOT NULL", "line_positive": "line >= 1", "line_at_most_seven": "line <= 7", "part_named": "l_partkey IS NOT NULL",
        "supplier_named": "l_suppkey IS NOT NULL", "quantity_whole": "qty = floor(qty)", "quantity_bounds": "qty BETWEEN 1 AND 50", "price_positive": "price > 0", "discount_bounds": "disc BETWEEN 0 AND 0.1",
        "tax_bounds": "tax BETWEEN 0 AND 0.08", "line_status_known": "l_linestatus IN ('O', 'F')", "return_flag_known": "l_returnflag IN ('R', 'A', 'N')", "label_is_the_flag": "(y = 1) = (l_returnflag = 'R')",
        "shipped": "l_shipdate IS NOT NULL", "order_found": "o_orderdate IS NOT NULL", "order_status_known": "o_orderstatus IN ('O', 'F', 'P')", "priority_known": "length(o_orderpriority) >= 5",
        "order_total_positive": "o_totalprice > 0", "part_found": "p_size IS NOT NULL", "size_bounds": "p_size BETWEEN 1 AND 50", "type_known": "p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD')",
        "brand_shape": "p_brand LIKE 'Brand#%'", "supplier_found": "s_acctbal IS NOT NULL", "balance_bounds": "s_acctbal BETWEEN -1000 AND 10000", "split_known": "split IN ('train', 'test')",
        "split_follows_the_order": "(split = 'test') = (grp % 5 = 0)", "price_at_least_discount": "price * disc < price", "shipped_after_ordered": "l_shipdate >= o_orderdate",
        **{f"{c}_within_clip": f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in BOUNDS.items()},
    },
    "orders": {"order_key": "o_orderkey IS NOT NULL", "customer_key": "o_custkey IS NOT NULL", "order_date": "o_orderdate IS NOT NULL", "total_positive": "o_totalprice > 0", "total_bounded": "o_totalprice < 1000000", "status_known": "o_orderstatus IN ('O', 'F', 'P')"},
    "part": {"part_key": "p_partkey IS NOT NULL", "part_name": "length(p_name) > 0", "part_size": "p_size BETWEEN 1 AND 50", "part_type": "p_type IS NOT NULL", "part_brand": "p_brand LIKE 'Brand#%'"},
    "supplier": {"supplier_key": "s_suppkey IS NOT NULL", "supplier_nation": "s_nationkey BETWEEN 0 AND 24", "supplier_balance": "s_acctbal > -1000"},
    "customer": {"customer_key": "c_custkey IS NOT NULL", "customer_nation": "c_nationkey BETWEEN 0 AND 24", "customer_balance": "c_acctbal > -1000"},
    "sales": {"sale_key": "sale_id IS NOT NULL", "sale_client": "client_id IS NOT NULL", "sale_total": "total >= 0", "sale_status": "length(status) > 0", "arrives_after_sold": "arrived_at >= sold_at"},
    "clicks": {"click_key": "click_id IS NOT NULL", "click_client": "client_id IS NOT NULL", "click_kind": "kind IS NOT NULL", "click_time": "ts IS NOT NULL", "arrives_after_click": "arrived_at >= ts"},
}
#: Key and conditions on all rows of a key.
GROUPS = {
    "facts": ("grp", {"order_in_one_split": "count(DISTINCT split) = 1", "lines_differ": "count(DISTINCT line) = count(*)", "one_order_date": "count(DISTINCT o_orderdate) <= 1", "one_order_status": "count(DISTINCT o_orderstatus) <= 1"}),
    "orders": ("o_orderkey", {"order_key_unique": "count(*) = 1"}),
    "part": ("p_partkey", {"part_key_unique": "count(*) = 1"}),
    "supplier": ("s_suppkey", {"supplier_key_unique": "count(*) = 1"}),
    "customer": ("c_custkey", {"customer_key_unique": "count(*) = 1"}),
    "sales": ("sale_id", {"sale_key_unique": "count(*) = 1"}),
    "clicks": ("click_id", {"click_key_unique": "count(*) = 1"}),
}


def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on the rows and keys of the given tables: rows are checked while a table is written, keys on what was written."""
    parts = []
    for name, conditions in ROWS.items():
        df = facts(spark, sf_dir) if name == "facts" else read(spark, sf_dir, name)
        key, per_key = GROUPS[name]
        used = [c for c in df.columns if c == key or any(c in text for text in (*conditions.values(), *per_key.values()))]
        table, found = lineage.written(df.select(*used), conditions)
        parts += [p.withColumn("table", F.lit(name)) for p in (found, lineage.group_checks(table, [key], per_key))]
    return reduce(DataFrame.unionByName, parts).select("table", "name", "required", "n_bad", "status")


def _text(condition: str) -> str:
    return "'" + condition.replace("'", "''") + "'"


def _checks_sql() -> str:
    """One scan per table and kind, as in the query."""
    out = []
    for name, conditions in ROWS.items():
        key, per_key = GROUPS[name]
        pairs = [(conditions, ", ".join(f"count(*) FILTER (WHERE NOT coalesce({c}, false)) AS c{i}" for i, c in enumerate(conditions.values())), f"FROM {name}")]
        each = ", ".join(f"coalesce({c}, false) AS ok{i}" for i, c in enumerate(per_key.values()))
        pairs.append((per_key, ", ".join(f"count(*) FILTER (WHERE NOT ok{i}) AS c{i}" for i in range(len(per_key))), f"FROM (SELECT {each} FROM {name} GROUP BY {key})"))
        for named, counts, source in pairs:
            rows = ", ".join(f"{{'name': '{n}', 'required': {_text(c)}, 'n': c{i}}}" for i, (n, c) in enumerate(named.items()))
            out.append(f"SELECT '{name}' AS tab, unnest([{rows}]) AS r FROM (SELECT {counts} {source})")
    return f"WITH {FACTS_SQL}, u AS ({' UNION ALL '.join(out)})"


TABLE_CHECKS = f"""{_checks_sql()} SELECT tab AS "table", r.name AS name, r.required AS required, r.n::BIGINT AS n_bad, CASE WHEN r.n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM u"""


def leakage_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stages from the matrix to the models read, by split, as their own jobs counted it."""
    # written once, as every stage reads it; what a stage reads is counted by its own jobs all the same
    f = stored(facts(spark, sf_dir).select(*dict.fromkeys(["grp", "split", "y", *NUMBERS, *(i.source for i in ITEMS)])), FINE)
    train, test, ledger = f.where("split = 'train'"), f.where("split = 'test'"), lineage.Ledger()
    fitted = prep.fit(ledger.reads("matrix", "medians", train), {k: BOUNDS[k] for k in ("qty", "price")}, [])
    assert set(fitted.medians) == {"qty", "price"}
    profile.label_signal(profile.long_form(ledger.reads("selection", "signal", train), ["y"], NUMBERS), "y").collect()
    rules.mine(ledger.reads("mining", "pairs", train), ITEMS, "y", (2,), SUPPORT, LIFT).count()
    rules.replay(ledger.reads("replay", "pairs", test), ITEMS, "y", _pair_table(spark)).count()
    I.patterns(ledger.reads("grading", "all rows", f), ITEMS, "y").count()
    screening.fit(ledger.reads("models", "logistic", train), ["qty", "price"], "y", "logistic")
    return ledger.matrix(spark)


LEAKAGE_LINEAGE = f"""WITH {FACTS_SQL}, n AS (SELECT count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split <> 'train') AS b FROM facts)
SELECT stage, input, CASE WHEN side <> 'test' THEN a ELSE 0 END AS n_train, CASE WHEN side <> 'train' THEN b ELSE 0 END AS n_other,
  CASE WHEN evaluates OR side = 'train' OR b = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM n, (VALUES ('matrix', 'medians', 'train', false), ('selection', 'signal', 'train', false), ('mining', 'pairs', 'train', false), ('replay', 'pairs', 'test', true),
  ('grading', 'all rows', 'both', true), ('models', 'logistic', 'train', false)) s(stage, input, side, evaluates)"""

NAMES = "table_checks leakage_lineage".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES}
