"""Mining, ranking, diverse selection and replay of association rules towards one label."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.functions import stats
from evimine.operators import items as I
from evimine.sources.scratch import FINE, stored

SEPARATOR = "||"
#: Baskets that one task of the frequent-pattern model reads at most, whatever the number of rows: some 50 MB in memory.
TASK_BASKETS = 500_000


def joined(items: Column) -> Column:
    return F.array_join(F.array_sort(items), SEPARATOR)


def score(lift: Column, confidence: Column, support: Column, n_families: Column, clarity: Column, n_items: Column) -> Column:
    return 0.42 * lift + 0.32 * confidence + 3.2 * support + 0.07 * n_families + 0.10 * clarity - 0.035 * n_items


def mine(train: DataFrame, items: list[I.Item], label: str, sizes: tuple[int, ...] = (2, 3, 4), min_support: float = 0.015, min_lift: float = 1.10) -> DataFrame:
    """All itemsets of these sizes whose joint support and lift reach the floors, from one scan of train."""
    rules = I.rule_table(train.sparkSession, items, sizes)
    found = I.measures(I.settled(I.evaluate(I.patterns(train, items, label), rules)))
    return found.where((F.col("support") >= min_support) & (F.col("lift") >= min_lift))


def mine_frequent(train: DataFrame, items: list[I.Item], label: str, min_support: float = 0.015, min_lift: float = 1.10, sizes: tuple[int, int] = (2, 4)) -> DataFrame:
    """The same by frequent-pattern growth, for manifests too wide to enumerate."""
    # a number an item, the label last: the model holds what it reads of every basket, and names would take some ten times as much
    hits = [F.when(item.column(), F.lit(k).cast("smallint")) for k, item in enumerate(items)]
    basket = F.array_compact(F.array(*hits, F.when(F.col(label) == 1, F.lit(len(items)).cast("smallint"))))
    # written, as the counts and every pass of the model read them; in small row groups, as a narrow table of many rows is else read by few tasks
    baskets = stored(train.select(basket.alias("basket"), F.col(label).cast("double").alias("y")), FINE)
    # the model counts non-empty baskets only
    n, some, base = baskets.agg(F.count(F.lit(1)), F.count_if(F.size("basket") > 0), F.avg("y")).first()
    tasks = -(-n // TASK_BASKETS)
    rows = baskets.where(F.size("basket") > 0).select("basket")
    model = FPGrowth(itemsCol="basket", minSupport=min_support, minConfidence=0.0).fit(rows.repartition(tasks) if tasks > rows.rdd.getNumPartitions() else rows)
    names = F.array(*(F.lit(i.name) for i in items))
    found = model.associationRules.where((F.col("consequent") == F.array(F.lit(len(items)).cast("smallint"))) & F.size("antecedent").between(*sizes))
    found = found.withColumn("antecedent", F.transform("antecedent", lambda k: F.get(names, k)))
    support = F.col("support") * some / n
    return found.select(joined(F.col("antecedent")).alias("antecedent"), support.alias("support"), "confidence", (F.col("confidence") / base).alias("lift")).where((F.col("lift") >= min_lift) & (F.col("support") >= min_support))


def ranked(found: DataFrame) -> DataFrame:
    """found with score and candidate_rank: by score, lift, confidence and support, then antecedent."""
    scored = found.withColumn("antecedent", joined(F.col("items"))).withColumn("score", score(F.col("lift"), F.col("confidence"), F.col("support"), F.size("families"), F.col("clarity"), F.col("n_items")))
    order = W.orderBy(F.desc(F.round("score", 12)), F.desc(F.round("lift", 12)), "antecedent")
    return scored.withColumn("candidate_rank", F.row_number().over(order))


def select_diverse(ranked_rules: DataFrame, axis: Column, most: int = 15, axis_caps: dict[str, int] | None = None, default_cap: int = 2, first_family_cap: int = 3, soft: dict[str, int] | None = None) -> list[dict]:
    """Rules taken greedily in rank order: no superset of a rule already taken, capped per axis, one per family signature,
    capped per first family; then one more, under the same caps but of any signature, for each axis that has fewer than soft
    asks for. Candidates are bounded by the manifest
    (itemsets above the floors), so they are walked on the driver, one partition at a time.
    """
    caps, taken, signatures, firsts, axes = axis_caps or {}, [], set(), {}, {}
    rows = [r.asDict() for r in ranked_rules.withColumn("axis", axis).orderBy("candidate_rank").toLocalIterator()]

    def fits(r: dict, repeat: bool) -> bool:
        if any(set(t["items"]) <= set(r["items"]) for t in taken) or (not repeat and "|".join(r["families"]) in signatures):
            return False
        return axes.get(r["axis"], 0) < caps.get(r["axis"], default_cap) and firsts.get(r["families"][0], 0) < first_family_cap

    def take(r: dict, rule_set: str) -> None:
        taken.append(r | {"signature": "|".join(r["families"]), "rule_set": rule_set})
        signatures.add(taken[-1]["signature"])
        axes[r["axis"]] = axes.get(r["axis"], 0) + 1
        firsts[r["families"][0]] = firsts.get(r["families"][0], 0) + 1

    for r in rows:
        if len(taken) == most:
            break
        if fits(r, repeat=False):
            take(r, "primary")
    for name, least in (soft or {}).items():
        if len(taken) < most and axes.get(name, 0) < least:
            found = next((r for r in rows if r["axis"] == name and r["clarity"] >= 0.85 and fits(r, repeat=True)), None)
            if found:
                take(found, "coverage")
    return taken


def replay(test: DataFrame, items: list[I.Item], label: str, rules: DataFrame) -> DataFrame:
    """rules with their test hits, Wilson bounds, risk ratio, exact enrichment p-value and q-value; one scan of test."""
    return replay_of(I.patterns(test, items, label), rules)


def replay_of(seen: DataFrame, rules: DataFrame) -> DataFrame:
    """The same from patterns (bits, n, y)."""
    return with_evidence(I.settled(I.evaluate(seen, rules)))


def with_evidence(seen: DataFrame) -> DataFrame:
    low, high = stats.wilson(F.col("hit_y"), F.col("hit"))
    base = F.col("positives") / F.nullif(F.col("total"), F.lit(0))
    conf = F.col("hit_y") / F.nullif(F.col("hit"), F.lit(0))
    out = seen.withColumns(
        {
            "base_rate": base,
            "test_support": F.col("hit") / F.nullif(F.col("total"), F.lit(0)),
            "test_confidence": conf,
            "wilson_lower": low,
            "wilson_upper": high,
            "risk_ratio": conf / F.nullif(base, F.lit(0.0)),
            "p_value": stats.binomial_tail(F.col("hit_y"), F.col("hit"), base),
        }
    )
    return stats.benjamini_hochberg(out, "p_value", "q_value")


def resolve_trace(items: Column, known: list[str]) -> Column:
    """Per rule: `item:resolved` or `item:missing_manifest` of each item, joined by a bar."""
    said = lambda i: F.concat(i, F.lit(":"), F.when(i.isin(*known), "resolved").otherwise("missing_manifest"))
    return F.array_join(F.transform(items, said), " | ")


def with_parents(triplets: DataFrame, pairs: DataFrame) -> DataFrame:
    """triplets with the lifts of their three pairs, the best of them, and the lift added over it."""
    of = pairs.select(F.col("bits").alias("pair_bits"), F.col("lift").alias("pair_lift"))
    three = F.array(*(F.array(F.get("items", a), F.get("items", b)) for a, b in ((0, 1), (0, 2), (1, 2))))
    each = triplets.select("antecedent", F.posexplode(three).alias("k", "pair"))
    lifts = each.join(pairs.select(F.col("items").alias("pair"), F.col("lift").alias("pair_lift")), "pair", "left")
    best = lifts.groupBy("antecedent").agg(F.max("pair_lift").alias("best_parent_lift"))
    return triplets.join(best, "antecedent", "left").withColumn("incremental_lift", F.col("lift") - F.col("best_parent_lift"))


def axis_capped(candidates: DataFrame, axis: str, order: list[Column], per_axis: int = 3, most: int = 20) -> DataFrame:
    """At most per_axis rows of each axis and most in all, in the given total order."""
    within = candidates.withColumn("_k", F.row_number().over(W.partitionBy(axis).orderBy(*order)))
    return within.where(F.col("_k") <= per_axis).orderBy(*order).limit(most).drop("_k")
