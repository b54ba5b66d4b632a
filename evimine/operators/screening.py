"""Feature screening and constrained composition, and the baseline models."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.functions import stats
from evimine.operators import packed, quantiles, ranks
from evimine.operators.triplets import PARTIAL, PURE
from evimine.sources.scratch import FINE, drop, ship, stored

#: Linear models, which are fitted for all splits in the same passes, and whether their penalty is absolute.
LINEAR = {"logistic": False, "lasso": True}

#: Rows of a hash partition within which rows are paired for shuffling.
PAIRED = 200_000
#: Splits whose rows are packed together.
SPLITS = 60
# Weights of the consensus score.
CONSENSUS = {"mean_points": 0.40, "vote_share": 0.24, "stability": 0.14, "permutation": 0.07, "priority": 0.15}


def consensus(columns: dict[str, Column] | None = None) -> Column:
    """The weighted blend; a missing part counts 0."""
    given = columns or {k: F.col(k) for k in CONSENSUS}
    return sum((w * F.coalesce(given[k], F.lit(0.0)) for k, w in CONSENSUS.items()), F.lit(0.0))


@dataclass
class Limits:
    size: int = 25
    family_min: dict[str, int] = field(default_factory=dict)
    family_cap: dict[str, int] = field(default_factory=dict)
    default_cap: int = 2
    semantic_cap: int = 1
    semantic_caps: dict[str, int] = field(default_factory=lambda: {"crash_contact_geometry": 2})
    source_cap: int = 1
    strict: tuple[str, ...] = ("age_over60",)
    forced: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def compose(candidates: list[dict], limits: Limits) -> tuple[list[dict], list[tuple[str, str]]]:
    """Features chosen in passes, and why others were not.

    candidates: feature, family, semantic, source and score, from a screening table of a few thousand rows, and where it applies: raw (a raw
    column that a derived feature stands for: never chosen), alias_of (not chosen beside that feature), missing (PURE is never chosen,
    PARTIAL in the last pass only). Passes: forced features; family minimums; all caps; without family cap; without source cap; without semantic
    cap, which strict meanings keep; partial ones. Ties go by name.
    """
    order = sorted(candidates, key=lambda c: (-c["score"], c["feature"]))
    chosen: list[dict] = []
    audit: list[tuple[str, str]] = []

    def count(key: str, value: str) -> int:
        return sum(c[key] == value for c in chosen)

    def refusal(c: dict, relaxed: set[str]) -> str:
        if c in chosen:
            return "chosen"
        if c["feature"] in limits.excluded:
            return "excluded"
        if c.get("raw"):
            return "raw column"
        if c.get("alias_of") and any(x["feature"] == c["alias_of"] for x in chosen):
            return "alias of a chosen feature"
        if c.get("missing") == PURE:
            return "purely missing"
        if c.get("missing") == PARTIAL and "partial" not in relaxed:
            return "partly unknown"
        if "family" not in relaxed and count("family", c["family"]) >= limits.family_cap.get(c["family"], limits.default_cap):
            return "family cap"
        if ("semantic" not in relaxed or c["semantic"] in limits.strict) and count("semantic", c["semantic"]) >= limits.semantic_caps.get(c["semantic"], limits.semantic_cap):
            return "semantic cap"
        if "source" not in relaxed and count("source", c["source"]) >= limits.source_cap:
            return "source cap"
        return ""

    def take(pool: list[dict], relaxed: set[str], most: int) -> None:
        for c in pool:
            if most <= 0 or len(chosen) >= limits.size:
                return
            if not (why := refusal(c, relaxed)):
                chosen.append(c)
                most -= 1
            elif why != "chosen" and not relaxed:
                audit.append((c["feature"], why))

    take([c for c in order if c["feature"] in limits.forced], {"family", "semantic", "source"}, limits.size)
    for family, least in limits.family_min.items():
        take([c for c in order if c["family"] == family], set(), least - count("family", family))
    for relaxed in (set(), {"family"}, {"family", "source"}, {"family", "source", "semantic"}):
        take([c for c in order if c.get("missing") != PARTIAL or not relaxed], relaxed, limits.size)
    take([c for c in order if c.get("missing") == PARTIAL], {"family", "source", "semantic", "partial"}, limits.size)
    return chosen, list(dict.fromkeys(audit))


def _assembled(df: DataFrame, features: list[str], label: str, medians: dict[str, float]) -> DataFrame:
    """df with its features as one vector; nulls become the medians of the rows that a model is fitted on, or 0 where there is none."""
    numbers = df.select("*", *(F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))).alias(f"_x_{c}") for c in features))
    return VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="_raw").transform(numbers).withColumn("_label", F.col(label).cast("double"))


def models(seed: int = 42, penalty: float = 0.0) -> dict[str, object]:
    """Estimators by name; penalty is that of a linear model per row. `extra` splits at few random-like edges without resampling rows."""
    common, linear = {"labelCol": "_label", "weightCol": "_weight"}, {"featuresCol": "_scaled", "maxIter": 100, "regParam": penalty}
    return {
        "logistic": LogisticRegression(elasticNetParam=0.0, **linear, **common),
        "lasso": LogisticRegression(elasticNetParam=1.0, **linear, **common),
        "forest": RandomForestClassifier(featuresCol="_raw", numTrees=50, maxDepth=6, seed=seed, **common),
        "extra": RandomForestClassifier(featuresCol="_raw", numTrees=50, maxDepth=6, maxBins=16, bootstrap=False, seed=seed, **common),
        "boosted": GBTClassifier(featuresCol="_raw", maxIter=20, maxDepth=3, seed=seed, **common),
    }


@dataclass
class Scorer:
    """A scaler and a model fitted on training rows."""

    features: list[str]
    medians: dict[str, float]
    scaler: object
    model: object

    def score(self, df: DataFrame, label: str, keep: list[str]) -> DataFrame:
        """keep, label and score (the positive class's probability) of df."""
        scored = self.model.transform(self.scaler.transform(_assembled(df, self.features, label, self.medians)))
        return scored.select(*keep, F.col(label).alias("label"), vector_to_array("probability")[1].alias("score"))


def fit(train: DataFrame, features: list[str], label: str, name: str, seed: int = 42) -> Scorer:
    """A model fitted with balanced classes; linear ones with unit strength of regularisation, which is 1 / rows per row."""
    medians = quantiles.medians(train, {c: F.col(c) for c in features}) if features else {}
    a = _assembled(train, features, label, medians)
    n, rate = a.agg(F.count(F.lit(1)), F.avg("_label")).first()
    rate = rate or 0.5
    weight = F.when(F.col("_label") == 1, 0.5 / max(rate, 1e-9)).otherwise(0.5 / max(1 - rate, 1e-9))
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True).fit(a)
    model = models(seed, 1 / max(n, 1))[name].fit(scaler.transform(a).withColumn("_weight", weight))
    return Scorer(features, medians, scaler, _without_summary(model))


def _without_summary(model):
    """model without the summary of its training, which holds the session: once a session has observed metrics, no task can carry it."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def fit_score(train: DataFrame, test: DataFrame, features: list[str], label: str, name: str, keep: list[str], seed: int = 42) -> tuple[object, DataFrame]:
    """A model fitted on train, and keep, label and score of test."""
    fitted = fit(train, features, label, name, seed)
    return fitted.model, fitted.score(test, label, keep)


def metric_row(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """auroc, average precision, recall, precision, balanced accuracy and F1.5 at one half."""
    scored = stored(scored.select(*by, "score", "label"))
    ranking = ranks.ranking_metrics(stats.score_counts(scored, "score", "label", by), "score", by)
    hit = F.col("score") >= 0.5
    one = F.col("label") == 1
    cells = scored.groupBy(*by).agg(*(F.count_if(c).cast("double").alias(n) for n, c in (("tp", hit & one), ("fp", hit & ~one), ("fn", ~hit & one), ("tn", ~hit & ~one))))
    c = {n: F.col(n) for n in ("tp", "fp", "fn", "tn")}
    ratio = lambda a, b: F.coalesce(a / F.nullif(a + b, F.lit(0.0)), F.lit(0.0))
    recall, precision, specificity = ratio(c["tp"], c["fn"]), ratio(c["tp"], c["fp"]), ratio(c["tn"], c["fp"])
    at = cells.select(*by, recall.alias("recall"), precision.alias("precision"), ((recall + specificity) / 2).alias("balanced_accuracy"), stats.f_beta(c["tp"], c["fp"], c["fn"]).alias("f_beta"))
    return ranking.join(at, list(by)) if by else ranking.crossJoin(at)


def holdouts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mean, standard deviation and number of repeated metrics."""
    return scored.groupBy(*by).agg(F.avg("auroc").alias("auroc_mean"), F.stddev_samp("auroc").alias("auroc_sd"), F.count(F.lit(1)).alias("n"))


def coefficients(model, features: list[str]) -> list[tuple[str, float]]:
    """Features and weights of a fitted linear model or forest, largest first."""
    return _largest((model.coefficients if hasattr(model, "coefficients") else model.featureImportances).toArray(), features)


def _largest(values: Iterable[float], features: list[str]) -> list[tuple[str, float]]:
    return sorted(((f, float(v)) for f, v in zip(features, values, strict=True)), key=lambda x: (-abs(x[1]), x[0]))


def with_fold(df: DataFrame, group: str, folds: int, seed: int = 42) -> DataFrame:
    """df with the fold (0 to folds - 1) of each row's group."""
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), group), F.lit(folds)).cast("int"))


@dataclass
class Folded:
    """Distinct rows with their fold and count, and the same packed: split t is trained by all folds but t."""

    rows: DataFrame
    packed: packed.Rows
    features: list[str]
    found: dict[str, list[packed.Linear]] = field(default_factory=dict)

    def linear(self, name: str) -> list[packed.Linear]:
        """A model per fold, trained on the others; sparse ones start from those without, and those from them, where there are any."""
        if name not in self.found:
            every = tuple(range(len(self.features)))
            self.found[name] = packed.linear(self.packed, [(t, every) for t in range(self.packed.splits)], LINEAR[name], next(iter(self.found.values()), None))
        return self.found[name]


def folded(df: DataFrame, features: list[str], label: str, group: str, folds: int) -> Folded:
    """df in folds by group. Equal rows are one row with its count, written once."""
    placed = with_fold(df.where(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label, group])), group, folds)
    some = placed.select("_fold", *features, F.col(label).alias("_y"))
    counted = stored(some.groupBy(*some.columns).agg(F.count(F.lit(1)).alias("_times")), FINE)
    return Folded(counted, packed.rows(counted, features, "_y", [F.col("_fold") != t for t in range(folds)], "_times"), features)


def stability(df: DataFrame, features: list[str], label: str, group: str, names: tuple[str, ...] = ("lasso", "forest"), folds: int = 5, top: int = 50, rows: Folded | None = None) -> dict[str, float]:
    """Share of fits (folds x models, each without one fold) that rank a feature among their top. rows: df's, from folded."""
    placed = with_fold(df.select(*dict.fromkeys([*features, label, group])), group, folds)
    votes = dict.fromkeys(features, 0)
    for name in names:
        if name in LINEAR:
            rows = rows or folded(df, features, label, group, folds)
            ranked = [_largest(m.coefficients(), features) for m in rows.linear(name)]
        else:
            ranked = [coefficients(fit(placed.where(F.col("_fold") != fold), features, label, name).model, features) for fold in range(folds)]
        for found in ranked:
            for f, v in found[:top]:
                votes[f] += v != 0
    return {f: n / (folds * len(names)) for f, n in votes.items()}


def partnered(df: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """df with `_s_<column>` from another row each, all columns of one partner; every row is a partner once.

    Rows are paired in the order of a second and a third hash within hash partitions of about PAIRED rows by their count,
    so a small table is shuffled whole and nothing of a large one is ordered globally. Equal rows share a partition.
    """
    parts = -(-df.count() // PAIRED) or 1
    hash_ = lambda salt: F.xxhash64(F.lit(salt), *[F.col(c) for c in df.columns])
    numbered = df.withColumn("_p", F.pmod(hash_(seed), F.lit(parts)))
    place = lambda salt: F.row_number().over(W.partitionBy("_p").orderBy(hash_(salt)))
    partners = numbered.select("_p", *(F.col(c).alias(f"_s_{c}") for c in columns), place(seed + 2).alias("_n"))
    return numbered.withColumn("_n", place(seed + 1)).join(partners, ["_p", "_n"]).drop("_p", "_n")


def f1_of(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    hit, one = F.col("score") >= 0.5, F.col("label") == 1
    cells = scored.groupBy(*by).agg(*(F.count_if(c).cast("double").alias(n) for n, c in (("tp", hit & one), ("fp", hit & ~one), ("fn", ~hit & one))))
    return cells.select(*by, stats.f_beta(F.col("tp"), F.col("fp"), F.col("fn"), 1.0).alias("f1"))


def permutation_importance(df: DataFrame, features: list[str], label: str, group: str, name: str = "logistic", folds: int = 3, repeats: int = 2, rows: Folded | None = None) -> dict[str, float]:
    """Mean loss of F1 on held-out folds of groups when a feature's values are shuffled, at least 0.

    One fit per fold. A repeat pairs every row with another once (as partnered, whose partner it has) and scores all features from it: the row with
    one value of its partner's, per feature. Linear models are fitted for all folds at once, and all folds and repeats are paired in one pass.
    rows: df's, from folded.
    """
    lost = dict.fromkeys(features, 0.0)
    if name in LINEAR:
        own = rows or folded(df, features, label, group, folds)
        cells = _moved_cells(own, own.linear(name), repeats)
        for (fold, feature), values in cells.items():
            if feature >= 0:
                lost[features[feature]] += sum(_f1(*cells[fold, -1][r]) - _f1(*values[r]) for r in range(repeats))
        return {f: max(0.0, v / (folds * repeats)) for f, v in lost.items()}
    placed = with_fold(df.select(*dict.fromkeys([*features, label, group])), group, folds)
    for fold in range(folds):
        test = placed.where(F.col("_fold") == fold).select(*features, F.col(label).alias("_y"))
        fitted = fit(placed.where(F.col("_fold") != fold), features, label, name)
        base = f1_of(fitted.score(test, "_y", [])).first()["f1"]
        for r in range(repeats):
            pairs = partnered(test, features, 101 * r + fold)
            each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), *(F.col(f"_s_{c}" if c == f else c).alias(c) for c in features)) for f in features)))
            moved = pairs.select("_y", each.alias("x")).select("_y", "x.*")
            for row in f1_of(fitted.score(moved, "_y", ["feature"]), ("feature",)).collect():
                lost[row["feature"]] += base - row["f1"]
    return {f: max(0.0, v / (folds * repeats)) for f, v in lost.items()}


def _f1(tp: float, fp: float, fn: float) -> float:
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def _moved_cells(rows: Folded, models: list[packed.Linear], repeats: int) -> dict[tuple[int, int], np.ndarray]:
    """Per fold and feature that is shuffled (-1: none), true and false positives and false negatives of each repeat.

    Rows are dealt out by the hash of partnered and paired there in the order of its two others. Equal rows are one with its count: a stretch of
    places that one row has in the first order and one in the second is a pair with the stretch's length.
    """
    names = [*rows.features, "_y"]
    sizes = {r["_fold"]: r["n"] for r in rows.rows.groupBy("_fold").agg(F.sum("_times").alias("n")).collect()}
    parts = F.get(F.array(*(F.lit(-(-sizes.get(t, 0) // PAIRED) or 1) for t in range(len(models)))), F.col("_fold"))
    hash_ = lambda more: F.xxhash64(101 * F.col("_r") + F.col("_fold") + more, *[F.col(c) for c in names])
    each = rows.rows.withColumn("_r", F.explode(F.array(*(F.lit(r) for r in range(repeats)))))
    keys = ["_fold", "_r", "_p"]
    dealt = each.withColumn("_p", F.pmod(hash_(0), parts)).repartition(*keys)
    numbers = dealt.select(*keys, "_times", F.col("_y").cast("double").alias("_y"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(rows.features)), hash_(1).alias("_a"), hash_(2).alias("_b"))

    def paired(table: pa.Table) -> pa.Table:
        fold, r = table.column("_fold")[0].as_py(), table.column("_r")[0].as_py()
        x = np.stack([table.column(f"x{i}").to_numpy().astype(np.float64) for i in range(len(names) - 1)])
        y, times = table.column("_y").to_numpy() == 1, table.column("_times").to_numpy()
        a, b = np.argsort(table.column("_a").to_numpy(), kind="stable"), np.argsort(table.column("_b").to_numpy(), kind="stable")
        upto_a, upto_b = np.cumsum(times[a]), np.cumsum(times[b])
        ends = np.union1d(upto_a, upto_b)
        n = np.diff(ends, prepend=0)
        row, partner = a[np.searchsorted(upto_a, ends)], b[np.searchsorted(upto_b, ends)]
        model = models[fold]
        z, out = model.scale.design(x, fold), []
        margin = model.weights @ z
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(-1, len(names) - 1):
                moved = margin[row] if i < 0 else margin[row] + model.weights[i + 1] * (z[i + 1, partner] - z[i + 1, row])
                hit, one = 1 / (1 + np.exp(-moved)) >= 0.5, y[row]
                out.append((fold, i, r, int(n[hit & one].sum()), int(n[hit & ~one].sum()), int(n[~hit & one].sum())))
        return pa.table(dict(zip(("fold", "feature", "repeat", "tp", "fp", "fn"), map(list, zip(*out)), strict=True)))

    ship(rows.rows.sparkSession)
    found = numbers.groupBy(*keys).applyInArrow(paired, "fold long, feature long, repeat long, tp long, fp long, fn long")
    cells = {(fold, f): np.zeros((repeats, 3)) for fold in range(len(models)) for f in range(-1, len(rows.features))}
    for c in found.groupBy("fold", "feature", "repeat").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn"))).collect():
        cells[c["fold"], c["feature"]][c["repeat"]] = c["tp"], c["fp"], c["fn"]
    return cells


def repeated_holdouts(df: DataFrame, features: list[str], label: str, group: str, names: tuple[str, ...] = ("logistic",), repeats: int = 10, percent: int = 20, seed: int = 42) -> list[dict]:
    """Metrics of every model fitted anew on each of so many seeded splits by group; one dict per split and model. Linear models of all splits are
    fitted and ranked in the same passes."""
    seeds, found = range(seed, seed + repeats), {}
    held = lambda s: F.pmod(F.xxhash64(F.lit(s), group), F.lit(100)) < percent
    linear = [name for name in names if name in LINEAR]
    for some in (seeds[i : i + SPLITS] for i in range(0, len(seeds) if linear else 0, SPLITS)):
        rows = packed.rows(df, features, label, [~held(s) for s in some])
        models = [(t, tuple(range(len(features)))) for t in range(len(some))]
        scorers = [m for name in linear for m in packed.linear(rows, models, LINEAR[name])]
        metrics = packed.held_out(rows, scorers, [t for t, _ in models] * len(linear))
        found.update(zip(((name, s) for name in linear for s in some), metrics, strict=True))
        drop(rows.blocks)
    out = []
    for s in seeds:
        for name in names:
            metrics = found.get((name, s)) or metric_row(fit(df.where(~held(s)), features, label, name, s).score(df.where(held(s)), label, [])).first().asDict()
            out.append({"model": name, "seed": s, **metrics})
    return out


def feature_sweep(train: DataFrame, test: DataFrame, ranked: list[str], label: str, sizes: tuple[int, ...], names: tuple[str, ...] = ("logistic", "forest", "boosted"), rows: packed.Rows | None = None) -> list[dict]:
    """Metrics of every model on test with the first so many of the ranked features. Linear and boosted models of all sizes take the same passes over
    packed rows. rows: those of train and test with all ranked features, where split 0 is train."""
    plain = [name for name in names if name in LINEAR or name == "boosted"]
    found = {}
    if plain and sizes:
        if rows is None:
            used = ranked[: max(sizes)]
            side = lambda df, own: df.select(*dict.fromkeys([*used, label]), F.lit(own).alias("_train"))
            rows = packed.rows(side(train, True).unionByName(side(test, False)), used, label, [F.col("_train")])
        subsets = [tuple(rows.features.index(f) for f in ranked[:n]) for n in sizes]
        scorers = [m for name in plain for m in (packed.boosted(rows, 0, subsets) if name == "boosted" else packed.linear(rows, [(0, s) for s in subsets], LINEAR[name]))]
        found = dict(zip(((name, n) for name in plain for n in sizes), packed.held_out(rows, scorers, [0] * len(scorers)), strict=True))
        drop(rows.blocks)
    other = lambda n, m: metric_row(fit(train, ranked[:n], label, m).score(test, label, [])).first().asDict()
    return [{"n_features": n, "model": m, **(found.get((m, n)) or other(n, m))} for n in sizes for m in names]


def wolf_search(features: list[str], fitness, wolves: int = 8, iterations: int = 8, penalty: float = 0.010, seed: int = 42) -> tuple[list[str], float]:
    """The best subset found by grey-wolf search: positions in [0, 1] per feature, drawn towards the three best, above one
    half is chosen. fitness (of a tuple of features) is computed once per subset; each chosen feature costs penalty / number of features."""
    import random

    r = random.Random(seed)
    known: dict[tuple[str, ...], float] = {}

    def value(at: list[float]) -> float:
        chosen = tuple(f for f, x in zip(features, at, strict=True) if x > 0.5)
        if chosen not in known:
            known[chosen] = (fitness(chosen) - penalty * len(chosen) / len(features)) if chosen else float("-inf")
        return known[chosen]

    pack = [[r.random() for _ in features] for _ in range(wolves)]
    for step in range(iterations):
        leaders = [list(p) for p in sorted(pack, key=value, reverse=True)[:3]]
        reach = 2 * (1 - step / iterations)
        for wolf in pack:
            for i in range(len(features)):
                pulls = []
                for leader in leaders:
                    a, c = reach * (2 * r.random() - 1), 2 * r.random()
                    pulls.append(leader[i] - a * abs(c * leader[i] - wolf[i]))
                wolf[i] = min(1.0, max(0.0, sum(pulls) / len(pulls)))
        for wolf in pack:
            value(wolf)
    best = max(known, key=lambda k: (known[k], -len(k), k))
    return list(best), known[best]


def method_comparison(chosen: dict[str, list[str]], reference: str, df: DataFrame, label: str, group: str, folds: int = 3) -> list[tuple[str, int, int, float]]:
    """Per method: number of features, overlap with the reference method's, and mean F1.5 over held-out folds."""
    placed = with_fold(df, group, folds)
    out = []
    for method, features in chosen.items():
        scores = []
        for fold in range(folds):
            _, scored = fit_score(placed.where(F.col("_fold") != fold), placed.where(F.col("_fold") == fold), features, label, "logistic", [])
            scores.append(metric_row(scored).first()["f_beta"])
        out.append((method, len(features), len(set(features) & set(chosen[reference])), sum(scores) / folds))
    return out


def family_coverage(candidates: DataFrame, selected: DataFrame, caps: dict[str, int], least: dict[str, int], default_cap: int = 2) -> DataFrame:
    """Per family (column family of both tables): candidates, selected, its cap and minimum, and whether both hold."""
    n = candidates.groupBy("family").agg(F.count(F.lit(1)).alias("n_candidates"))
    s = selected.groupBy("family").agg(F.count(F.lit(1)).alias("n_selected"))
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,int>")
    joined = n.join(s, "family", "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))
    joined = joined.withColumns({"cap": F.coalesce(table(caps)[F.col("family")], F.lit(default_cap)), "least": F.coalesce(table(least)[F.col("family")], F.lit(0))})
    return joined.withColumn("satisfied", F.col("n_selected").between(F.col("least"), F.col("cap")))
