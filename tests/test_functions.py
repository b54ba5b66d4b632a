"""Statistics, names and texts against worked values and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evimine.functions import stats, taxonomy, text


def test_wilson_and_enrichment(spark):
    df = spark.createDataFrame([(131, 168), (113, 142), (0, 0), (0, 5), (5, 5)], "s long, n long")
    low, high = stats.wilson(F.col("s"), F.col("n"))
    rows = df.select(low.alias("l"), high.alias("h"), stats.binomial_tail(F.col("s"), F.col("n"), F.lit(0.656298600311042)).alias("p")).collect()
    assert (rows[0]["l"], rows[0]["h"]) == (pytest.approx(0.7112317489443875), pytest.approx(0.8357836419737604))
    assert rows[0]["p"] == pytest.approx(0.0003394855145208, rel=1e-9) and rows[1]["p"] == pytest.approx(0.0001958422011279, rel=1e-9)
    assert rows[2]["l"] is None and rows[2]["p"] is None and rows[3]["l"] == 0 and rows[4]["h"] == 1 and rows[3]["p"] == pytest.approx(1)


def test_binomial_tail_equals_the_sum(spark):
    cases = [(k, n, p) for n in (1, 7, 60) for k in range(0, n + 1, 3) for p in (0.01, 0.5, 0.93)] + [(10**6 // 2 + 700, 10**6, 0.5)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for r in df.select("*", stats.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect():
        if r["n"] <= 60:
            exact = sum(math.comb(r["n"], i) * r["p"] ** i * (1 - r["p"]) ** (r["n"] - i) for i in range(r["k"], r["n"] + 1))
            assert r["t"] == pytest.approx(exact, rel=1e-8)
        else:
            assert r["t"] == pytest.approx(0.5 * math.erfc((700 - 0.5) / 500 / math.sqrt(2)), rel=1e-3)


def test_q_values_are_monotone_and_at_least_p(spark):
    @settings(max_examples=10, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.floats(0, 1)), min_size=1, max_size=30))
    def check(ps):
        df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
        rows = sorted(stats.benjamini_hochberg(df, "p", "q").collect(), key=lambda r: (r["p"] is None, r["p"] or 0))
        some = [r for r in rows if r["p"] is not None]
        m, best = len(some), 1.0
        for k in range(m, 0, -1):
            best = min(best, some[k - 1]["p"] * m / k)
            assert some[k - 1]["q"] == pytest.approx(best) and some[k - 1]["q"] >= some[k - 1]["p"] * (1 - 1e-12)
        assert all(r["q"] is None for r in rows if r["p"] is None) and len(rows) == len(ps)

    check()


def test_names_are_labelled_in_order(spark):
    # name, family, semantic group, source group, threshold
    expected = [
        ("FEATURE_Age_Over60", "age", "age_over60", "FEATURE_Age_Over60", "domain_age_60"),
        ("VEH_意识到危险前的初始速度_V0", "speed_v0", "precrash_speed", "V0", "domain_speed_50"),
        ("VEH_碰撞速度_VK", "speed_vk", "impact_speed", "VK", "domain_speed_50"),
        ("性别_GESCHL_3-男性", "bio", "sex", "GESCHL", "train_median_exploratory"),
        ("VEH_车宽_BREITE", "vehicle_size", "vehicle_geometry_width", "BREITE", "train_median_vehicle_size"),
        ("车道保持_SPURHAE", "lane", "safety_assistance", "车道保持_SPURHAE", "train_median_exploratory"),
        ("VEH_LAENGE", "vehicle_size", "vehicle_geometry_length", "LAENGE", "train_median_exploratory"),
    ]
    df = spark.createDataFrame([(e[0],) for e in expected], "name string")
    name = F.col("name")
    got = df.select(name, taxonomy.family(name), taxonomy.semantic_group(name), taxonomy.source_group(name), taxonomy.threshold_source(name)).collect()
    assert [tuple(r) for r in got] == expected


def test_missing_categories(spark):
    names = {"x_99-未知": "pure_missing_unknown", "有_具体未知": "partial_unknown_detail", "MISSING_OR_UNKNOWN": "pure_missing_unknown", "V0": "not_missing_category"}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r[0]: r[1] for r in df.select("name", taxonomy.missing_category(F.col("name"))).collect()} == names


def test_axes(spark):
    cases = [
        (["age", "speed_v0", "speed_vk"], ["FEATURE_Age_Over60", "V0", "VK"], "speed_energy"),
        (["age", "speed_vk", "vehicle_size"], ["FEATURE_Age_Over60", "VK", "BREITE"], "vehicle_geometry_vulnerability"),
        (["bio", "speed_v0"], ["V0", "性别_GESCHL_3-男性"], "vulnerability_demographic_speed"),
        (["age"], ["FEATURE_Age_Over60"], "mixed_multimechanism"),
        (["light"], ["BLICHT"], "lighting_visibility"),
    ]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "f array<string>, n array<string>")
    assert [r[0] for r in df.select(taxonomy.mechanism_axis(F.col("f"), F.col("n"))).collect()] == [c[2] for c in cases]


def test_texts(spark):
    rows = [("45",), ("999-未知",), (" 12.0",), ("nan",), ("",), (None,), ("-3.5 kg",), ("9-x",), ("3-男性",)]
    t = F.col("t")
    got = spark.createDataFrame(rows, "t string").select(text.normalize_key(t), text.first_number(t), text.code_digit(t), text.sentinel(t, (45.0,))).collect()
    assert [r[0] for r in got] == ["45", "999-未知", "12", None, None, None, "-3.5 kg", "9-x", "3-男性"]
    assert [r[1] for r in got] == [45.0, 999.0, 12.0, None, None, None, -3.5, 9.0, 3.0]
    assert [r[2] for r in got] == [4, None, 1, None, None, None, 3, None, 3]
    assert [r[3] for r in got] == [True, True, False, True, False, False, False, False, False]


def test_item_names_and_labels(spark):
    df = spark.createDataFrame([("V0", ">", 50.0, "precrash_speed"), ("x", "<=", -0.5, "other")], "s string, o string, t double, g string")
    name = text.item_name(F.col("s"), F.col("o"), F.col("t"))
    got = df.select(name, taxonomy.display_label(F.col("s"), name, F.col("o"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("V0___GT_50_0", "Initial speed > 50 km/h"), ("x___LE_m0_5", "x___LE_m0_5")]


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(18.0,), (18.1,), (60.0,), (151.0,), (None,)], "v double")
    assert [r[0] for r in df.select(text.right_closed(F.col("v"), (-1, 18, 60, 150), ("a", "b", "c"))).collect()] == ["a", "b", "b", None, None]


def test_age_as_a_token_of_its_own(spark):
    from evimine.functions import taxonomy

    rows = [(["vehicle_mass", "vehicle_size"], ["GEWGES_AGE_X", "VEHICLE_LENGTH___GT_40"]), (["vehicle_mass", "vehicle_size"], ["GEWGES_USAGE_X", "VEHICLE_LENGTH___GT_40"])]
    found = [r[0] for r in spark.createDataFrame(rows, "f array<string>, n array<string>").select(taxonomy.mechanism_axis(F.col("f"), F.col("n"))).collect()]
    assert found[0] != found[1] and "vulnerability" in found[0]
