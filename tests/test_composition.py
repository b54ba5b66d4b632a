"""Rules of composition that keep features back, and models on imputed rows."""

import random

from evimine.operators import screening


def made(**kinds):
    base = {"family": "f", "semantic": None, "source": None, "raw": False, "alias_of": None, "missing": None}
    return [base | {"feature": n, "semantic": n, "source": n, "score": s} | more for n, (s, more) in kinds.items()]


def test_raw_alias_and_missing_types():
    limits = screening.Limits(size=5, default_cap=9, forced=("over60",))
    rows = made(over60=(0.1, {"semantic": "age_over60"}), raw_age=(0.9, {"raw": True}), group=(0.8, {"alias_of": "over60"}), unknown=(0.7, {"missing": screening.PURE}), partly=(0.6, {"missing": screening.PARTIAL}), twin=(0.5, {"semantic": "age_over60"}), plain=(0.4, {}))
    chosen, audit = screening.compose(rows, limits)
    assert [c["feature"] for c in chosen] == ["over60", "plain", "partly"]
    assert dict(audit) == {"raw_age": "raw column", "group": "alias of a chosen feature", "unknown": "purely missing", "partly": "partly unknown", "twin": "semantic cap"}


def test_partly_unknown_waits_for_all_others():
    rows = made(partly=(0.9, {"missing": screening.PARTIAL}), a=(0.5, {}), b=(0.4, {"semantic": "a", "source": "a"}), free=(0.3, {"alias_of": "absent"}))
    assert [c["feature"] for c in screening.compose(rows, screening.Limits(size=4))[0]] == ["a", "free", "b", "partly"]
    assert [c["feature"] for c in screening.compose(rows, screening.Limits(size=2))[0]] == ["a", "free"]


def test_models_impute_training_medians(spark):
    """Where a value is missing the model sees the training median, not 0, which lies far outside here."""
    r = random.Random(1)
    rows = [(i, int(i % 3 == 0), None if i % 5 == 0 else 100 + 4 * (i % 3 == 0) + r.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "g long, y int, x double")
    fitted = screening.fit(df, ["x"], "y", "logistic")
    known = sorted(v for _, _, v in rows if v is not None)
    assert abs(fitted.medians["x"] - (known[239] + known[240]) / 2) < 1e-9
    missing = fitted.score(df.where("x IS NULL"), "y", ["g"]).select("score").distinct().collect()
    assert len(missing) == 1 and 0.05 < missing[0][0] < 0.95
    assert screening.metric_row(fitted.score(df.where("x IS NOT NULL"), "y", [])).first()["auroc"] > 0.98
