"""Registered grading uses the q-values and recurrences as measured."""

import pytest
from pyspark.sql import functions as F

from evimine.operators import evidence
from evimine.plans import rule_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graded(spark):
    return rule_queries._graded(spark, SF).select("antecedent", "q_value", "recurrence", "tier").collect()


def test_grading_keeps_the_measured_evidence(spark, graded):
    q = {r["antecedent"]: r["q_value"] for r in rule_queries._replayed(spark, SF).select("antecedent", "q_value").collect()}
    again = {r["antecedent"]: r["recurrence"] for r in rule_queries.group_bootstrap(spark, SF).collect()}
    assert {r["antecedent"]: r["q_value"] for r in graded} == pytest.approx(q)
    assert all(r["recurrence"] == pytest.approx(again[r["antecedent"]], abs=1e-6) for r in graded)


def test_confirmed_tiers_pass_their_limits(graded):
    for r in graded:
        if r["tier"] in (evidence.CORE, evidence.BINARY, evidence.STATISTICAL):
            assert r["q_value"] <= evidence.Q
        if r["tier"] in (evidence.CORE, evidence.BINARY):
            assert r["recurrence"] >= evidence.RECURRENCE


def test_no_rule_plan_has_a_cartesian_product(spark):
    from evimine.operators import items as I
    from evimine.plans.facts import ITEMS, facts

    seen = I.patterns(facts(spark, SF), ITEMS, "y")
    plan = I.evaluate(seen, I.rule_table(spark, ITEMS, (2, 3)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("FileScan") <= 4
    for name in ("triplet_candidates", "topk_summary", "evidence_tiers"):
        assert "CartesianProduct" not in rule_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_measures_the_antecedent_and_takes_any_group_id(spark):
    from evimine.operators import items as I

    items = [I.Item("a", "x", ">", 0.0, "f"), I.Item("b", "x", ">", 1.0, "g")]
    rows = [(f"group {i}" if i % 7 else None, float(i % 3), int(i % 3 == 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "grp string, x double, y int")
    table = I.rule_table(spark, items, (1, 2))
    got = {tuple(r["items"]): r for r in evidence.bootstrap(df, items, "y", "grp", table, 40).collect()}
    assert got["a", "b"]["recurrence"] == 1.0 and got["a",]["recurrent"] == 40
    few = evidence.bootstrap(df.limit(5), items, "y", "grp", table, 40).collect()
    assert all(r["recurrent"] == 0 and r["recurrence"] == 0.0 for r in few)
    # rare labels: the antecedent is frequent although antecedent and label together are not
    rare = spark.createDataFrame([(str(i), 2.0 if i % 2 else 0.0, int(i == 1 or i == 3)) for i in range(400)], "grp string, x double, y int")
    assert evidence.bootstrap(rare, items, "y", "grp", table, 40).where("n_items = 2").first()["recurrence"] > 0.8


def test_soft_pass_keeps_all_caps(spark):
    from pyspark.sql import functions as F

    from evimine.operators import rules

    rows = [(["a", "b"], ["f", "g"], 1.0, 1, "x"), (["a", "c"], ["f", "g"], 1.0, 2, "y"), (["a", "d"], ["f", "g"], 1.0, 3, "y"), (["a", "b", "e"], ["f", "h"], 1.0, 4, "z"), (["e", "h"], ["k"], 0.5, 5, "z")]
    df = spark.createDataFrame(rows, "items array<string>, families array<string>, clarity double, candidate_rank int, ax string")
    taken = rules.select_diverse(df, F.col("ax"), soft={"y": 2, "z": 1})
    assert [(t["candidate_rank"], t["rule_set"]) for t in taken] == [(1, "primary"), (5, "primary"), (2, "coverage")]


def test_bootstrap_weights_rows_where_they_are_read(spark, monkeypatch):
    """No table of groups is made, and the sums are those of the definition, for null groups and labels too."""
    from evimine.operators import evidence
    from evimine.operators import items as I

    items = [I.Item("a", "v", ">", 3.0), I.Item("b", "w", "==", "x")]
    rows = [(None if i % 17 == 0 else i // 3, i % 2 if i % 5 else None, float(i % 7), "xy"[i % 3 == 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, y int, v double, w string").repartition(3)
    monkeypatch.setattr(evidence, "PATTERNS_HELD", 2)
    batches = df.select(I.pattern(items).alias("bits"), F.coalesce(F.col("y").cast("long"), F.lit(0).cast("long")).alias("y"), F.unhex(F.md5(F.coalesce(F.col("g").cast("string"), F.lit("")))).alias("digest")).toArrow().to_batches()
    found = {}
    for out in evidence._weighted(iter(batches), 40):
        for r in out.to_pylist():
            n, y = found.get((r["iteration"], r["bits"]), (0, 0))
            found[r["iteration"], r["bits"]] = (n + r["n"], y + r["y"])
    each = df.select(I.pattern(items).alias("bits"), "y", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("iteration"), *(c.alias(f"s{i}") for i, c in enumerate(evidence.draw_seeds(F.col("g")))))
    want = each.withColumn("w", evidence.multiplicity(F.col("s0"), F.col("s1"), F.col("iteration"))).groupBy("iteration", "bits").agg(F.sum("w").alias("n"), F.coalesce(F.sum(F.col("w") * F.col("y")), F.lit(0)).alias("y"))
    assert found == {(r["iteration"], r["bits"]): (r["n"], r["y"]) for r in want.where("n > 0").collect()}
    monkeypatch.setattr(I, "patterns", lambda *a, **k: pytest.fail("a table of groups"))
    table = I.rule_table(spark, items, (2,))
    assert evidence.bootstrap(df, items, "y", "g", table, 40).count() == 1
