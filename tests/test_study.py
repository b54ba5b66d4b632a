"""Labels, triplet evidence, flags, ages and checks on worked values."""

import pytest
from pyspark.sql import functions as F

from evimine.functions import taxonomy, text
from evimine.operators import audit, evidence, prep, rules, triplets

# Published labels of a manifest: source feature, family, semantic group, source group, axis, threshold.
LABELS = [
    ("FEATURE_Age_Over60", "age", "age_over60", "FEATURE_Age_Over60", "mixed_multimechanism", "binary_column"),
    ("VEH_意识到危险前的初始速度_V0", "speed_v0", "precrash_speed", "V0", "speed_energy", "domain_speed_50"),
    ("VEH_碰撞速度_VK", "speed_vk", "impact_speed", "VK", "speed_energy", "domain_speed_50"),
    ("体重估计_GEWPG", "bio", "weight_body_size", "GEWPG", "vulnerability_body", "train_median_weight"),
    ("路灯_STRABEL_0-无路灯", "light", "lighting_visibility", "路灯_STRABEL", "lighting_visibility", "binary_column"),
    ("事故现场道路环境_STFUHO_4-环形交叉", "road_env", "road_environment_type", "STFUHO", "mixed_multimechanism", "binary_column"),
    ("公路分类_STRKL_1-公路以外的其他道路", "road_type", "other_unique:STRKL", "STRKL", "mixed_multimechanism", "binary_column"),
    ("路面附着系数_MUE", "road_surface", "other_unique:MUE", "MUE", "surface_weather_friction", "domain_friction_0_5"),
    ("VEH_车高_HOEHE", "vehicle_size", "vehicle_geometry_height", "HOEHE", "vehicle_geometry_interaction", "train_median_vehicle_size"),
    ("主动安全场景_ACSCE_1101-C1-穿行遇从右侧来的目标物", "safety", "safety_assistance", "ACSCE", "safety_assistance", "binary_column"),
    ("VEH_车上第一碰撞点Y向坐标_BRPY", "crash_type", "crash_contact_geometry", "BRPY", "crash_configuration", "train_median_exploratory"),
    ("行驶车辆所在车道_FSTREIF_3-单向车道_单车道", "lane", "other_unique:行驶车辆所在车道_FSTREIF_3-单向车道", "行驶车辆所在车道_FSTREIF_3-单向车道", "mixed_multimechanism", "binary_column"),
    ("风速_WINDS", "weather", "weather_wind", "风速_WINDS", "surface_weather_friction", "train_median_exploratory"),
    ("VEH_车上第一碰撞点Z向坐标_BRPZ", "crash_type", "crash_contact_geometry", "BRPZ", "crash_configuration", "train_median_exploratory"),
    ("性别_GESCHL_3-男性", "bio", "sex", "GESCHL", "mixed_multimechanism", "binary_column"),
    ("VEH_第一轴右侧轮胎胎面状态_TIREDA1R_1-未损坏", "other", "other_unique:VEH_第一轴右侧轮胎胎面状态_TIREDA1R", "VEH_第一轴右侧轮胎胎面状态_TIREDA1R", "mixed_multimechanism", "binary_column"),
    ("VEH_车辆用途_VEHUSAGE_16-私用", "vehicle_state", "other_unique:VEHUSAGE", "VEHUSAGE", "vehicle_geometry_interaction", "binary_column"),
    ("身高估计_GROESPG", "bio", "height_body_size", "GROESPG", "vulnerability_body", "train_median_height"),
    ("VEH_碰撞前的制动距离_WEGV", "crash_type", "other_unique:VEH_碰撞前的制动距离", "VEH_碰撞前的制动距离", "crash_configuration", "train_median_exploratory"),
    ("事故参与人数_ANZPERS_3-3", "other", "other_unique:事故参与人数_ANZPERS", "事故参与人数_ANZPERS", "mixed_multimechanism", "binary_column"),
    ("VEH_车长_LAENGE", "vehicle_size", "vehicle_geometry_length", "LAENGE", "vehicle_geometry_interaction", "train_median_vehicle_size"),
    ("道路类型_STRART_15-公路_四级公路", "road_type", "other_unique:STRART", "STRART", "mixed_multimechanism", "binary_column"),
    ("VEH_车宽_BREITE", "vehicle_size", "vehicle_geometry_width", "BREITE", "vehicle_geometry_interaction", "train_median_vehicle_size"),
    ("VEH_碰撞时的总重_GEWGES", "vehicle_mass", "vehicle_mass", "GEWGES", "vehicle_mass_speed_energy", "train_median_vehicle_mass"),
    ("不同行驶方向车道的隔离方法_MARK_11-防撞栏", "lane", "other_unique:MARK", "MARK", "mixed_multimechanism", "binary_column"),]


def test_published_labels(spark):
    df = spark.createDataFrame([(r[0],) for r in LABELS], "name string")
    n = F.col("name")
    axis = taxonomy.mechanism_axis(F.array(taxonomy.family(n)), F.array(n))
    got = {r["name"]: r for r in df.select("name", taxonomy.family(n).alias("f"), taxonomy.semantic_group(n).alias("s"), taxonomy.source_group(n).alias("g"), axis.alias("a"), taxonomy.threshold_source(n).alias("t"), taxonomy.missing_category(n).alias("m")).collect()}
    for name, family, semantic, source, axis_label, threshold in LABELS:
        r = got[name]
        assert (r["f"], r["s"], r["g"], r["a"], r["m"]) == (family, semantic, source, axis_label, "not_missing_category")
        assert threshold == "binary_column" or r["t"] == threshold


def test_age_names(spark):
    cases = {"ALTER1": (True, True), "x(ALTER1)": (True, True), "FEATURE_Age_Years": (True, True), "FEATURE_Age_Over60": (False, True), "VEHUSAGE_AGE": (False, False), "usage age": (False, False), "年龄段": (False, True), "LANE": (False, False)}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r[0]: (r[1], r[2]) for r in df.select("name", taxonomy.is_raw_age(F.col("name")), taxonomy.is_age_related(F.col("name"))).collect()} == cases


def manifest(spark):
    rows = [("a", "age", "s1", "x", "not_missing_category", 1), ("b", "light", "s2", "y", "not_missing_category", 1), ("c", "safety", "s3", "z", "not_missing_category", 1), ("p", "lane", "s4", "u", triplets.PURE, 1),
            ("q", "lane", "s5", "v", triplets.PARTIAL, 1), ("d", "age", "s1", "w", "not_missing_category", 1), ("e", "weather", "s6", "x", "not_missing_category", 1), ("o", "other", "s7", "t", "not_missing_category", 0), ("r", "other2", "s8", "t2", "not_missing_category", 1)]
    return spark.createDataFrame(rows, "item string, family string, semantic string, source string, missing string, physical int")


def test_admission(spark):
    wanted = {("a", "b", "c"): True, ("a", "b", "p"): False, ("a", "b", "q"): True, ("a", "b", "d"): False, ("a", "b", "e"): False, ("a", "b", "unknown"): False, ("a", "d"): False, ("o", "r"): False, ("a", "o"): True}
    df = spark.createDataFrame([("||".join(k), list(k)) for k in wanted], "antecedent string, items array<string>")
    kept = {tuple(r["items"]) for r in triplets.admitted(df, manifest(spark)).collect()}
    assert kept == {k for k, v in wanted.items() if v}
    assert {tuple(r["items"]) for r in triplets.without_items(df, ["a"]).collect()} == {("o", "r")} and triplets.without_items(df, []).count() == len(wanted)


def test_triplet_grades_and_eligibility(spark):
    # antecedent, items, hit, q, risk ratio, continuous, recurrence, hit_min, lift_min -> tier, valid, main, supplementary
    cases = [
        ("a||b||c", 9, 0.01, 1.2, 1, 1.0, 6, 1.1, evidence.CORE, 1, 1, 0),
        ("a||b||o", 9, 0.01, 1.2, 1, 1.0, 6, 1.1, evidence.CORE, 0, 0, 1),
        ("a||c||q", 9, 0.01, 1.2, 0, 1.0, None, None, evidence.BINARY, 0, 0, 1),
        ("b||c||e", 9, 0.01, 1.2, 0, 1.0, None, None, evidence.BINARY, 1, 1, 0),
        ("a||b||e", 9, 0.01, 1.2, 1, 1.0, 4, 1.1, evidence.STATISTICAL, 1, 0, 1),
        ("a||c||e", 9, 0.20, 1.2, 1, 1.0, 6, 1.1, evidence.REPLAYABLE, 1, 0, 1),
        ("a||b||d", 9, 0.01, 1.2, 0, 1.0, None, None, evidence.BINARY, 0, 0, 1),
    ]
    seen = spark.createDataFrame([(c[0], c[0].split("||"), c[1], c[2], c[3], c[4], True, f"T{i:02d}") for i, c in enumerate(cases)], "antecedent string, items array<string>, hit long, q_value double, risk_ratio double, continuous int, resolved boolean, rule_id string")
    boot = spark.createDataFrame([(c[0], c[5]) for c in cases], "antecedent string, recurrence double")
    moved = spark.createDataFrame([(c[0], c[6], c[7]) for c in cases], "antecedent string, hit_min long, lift_min double")
    items = manifest(spark).withColumn("unobserved_share", F.when(F.col("item") == "nothing", 1.0).otherwise(0.1))
    rows = triplets.with_validity(triplets.graded(seen, boot, moved), items)
    got = {r["antecedent"]: r for r in rows.collect()}
    for c in cases:
        r = got[c[0]]
        assert (r["tier"], r["physical_valid"], r["main_text"], r["supplementary"]) == c[8:], c
        assert r["physical_tier"] == (r["tier"] if c[9] else triplets.INVALID_TIER) and r["use"] == triplets.USES[r["tier"]]
    assert [r["antecedent"] for r in triplets.main_table(rows).collect()] == ["a||b||c", "b||c||e"]
    said = {r["antecedent"]: r["interpretation"] for r in triplets.interpretation(rows, F.lit("plain")).collect()}
    assert said["a||b||e"] == triplets.SENSITIVE and said["a||b||c"] == "plain"
    assert {r["status"] for r in triplets.output_checks(rows).collect()} == {"PASS"}
    assert triplets.released(rows).where("main_text = 1").count() == 2
    broken = rows.withColumn("semantic_duplicate", F.lit(1))
    assert triplets.output_checks(broken).where("status = 'FAIL'").count() == 1
    assert triplets.released(broken).where("main_text + manuscript > 0 OR supplementary = 0").isEmpty()
    # an item that is mostly unknown makes every rule that holds it invalid
    dominated = triplets.with_validity(triplets.graded(seen, boot, moved), items.withColumn("unobserved_share", F.when(F.col("item") == "b", 0.5).otherwise(0.0)))
    assert dominated.where("physical_valid = 1 AND array_contains(items, 'b')").isEmpty()


def test_flags_tolerant_and_strict(spark):
    rows = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, 3.0, "z")], "row_id long, v double, w string")
    flags = spark.createDataFrame([(2, 0), (1, 1)], "row_id long, v int")
    got = {r["row_id"]: (r["_unobserved_v"], r["_unobserved_w"]) for r in prep.with_flags(rows, flags, ["v", "w"], strict=False).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, False)}
    assert prep.with_flags(rows, None, ["v"], strict=False).where("_unobserved_v").isEmpty()
    whole = flags.union(spark.createDataFrame([(3, None)], "row_id long, v int"))
    assert prep.with_flags(rows, whole, ["v"]).where("_unobserved_v").count() == 2
    for bad in (None, flags, whole.union(whole.limit(1)), whole.withColumn("other", F.lit(1))):
        with pytest.raises(prep.FlagsError):
            prep.with_flags(rows, bad, ["v"])


def test_ages(spark):
    rows = [("train", "45"), ("train", "61 years"), ("train", "999-未知"), ("train", "130"), ("test", None), ("test", "60"), ("test", "60.5"), ("test", "-1")]
    got = {r["split"]: r for r in prep.over_age_audit(spark.createDataFrame(rows, "split string, age string"), "age").collect()}
    assert (got["train"]["n_over"], got["train"]["n_unknown"], got["test"]["n_over"], got["test"]["n_unknown"]) == (1, 2, 1, 2)


def test_names_labels_and_formats(spark):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "place int, name string")
    assert [r["unique_name"] for r in prep.unique_names(names).orderBy("place").collect()] == ["a", "b", "a__dup1", "a__dup2"]
    row = spark.range(1).select(
        text.short_label(F.lit("  a \n b\t c "), 4), text.short_label(F.lit(None).cast("string")), text.count_summary(F.lit(12), F.lit(0.345)), text.spread_summary(*(F.lit(x) for x in (1.0, 0.5, 1.25, 0.25, 2.0))),
        text.within(F.lit(130.0), 0, 120), text.within(F.lit(120.0), 0, 120), rules.resolve_trace(F.array(F.lit("a"), F.lit("b")), ["a"]),
    ).first()
    assert tuple(row) == ("a b ", "None", "12 (34.5%)", "1.000 ± 0.500; 1.250 [0.250, 2.000]", None, 120.0, "a:resolved | b:missing_manifest")
    many = spark.range(100).select(F.lit(1).alias("g"), F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert many.groupBy("g").agg(text.capped_list(F.col("v"), 3).alias("l")).first()["l"] == "000||001||002"
    assert prep.with_schema(names, ["name", "absent"]).columns == ["name", "absent"]


def test_levels_are_all_kept(spark):
    train = spark.range(2500).select(F.concat(F.lit("level"), F.col("id").cast("string")).alias("c"))
    assert len(prep.fit(train, {}, ["c"]).levels["c"]) == 2500


def test_checks(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    assert audit.same_rows(a, a.distinct(), ["k"]).first()["equal"]
    r = audit.same_rows(a, a.where("k = 1"), ["k"]).first()
    assert (r["n_only_a"], r["n_only_b"], r["equal"]) == (2, 0, False)
    assert audit.package_checks(True, False, ["x", "y"], ["x"], 0)[0][1] == "FAIL: y" and audit.package_checks(True, False, ["x"], ["x"], 0)[0][1] == "PASS"
    assert audit.package_checks(False, False, [], [], 0)[0][1] == "PASS" and audit.package_checks(False, False, [], [], 3)[0][1] == "FAIL"
    assert audit.package_checks(False, True, [], [], None)[0][1] == "PASS" and audit.package_checks(False, False, [], [], None)[0][1] == "FAIL"
    from evimine.operators.items import Item

    with pytest.raises(audit.ChecksFailed):
        audit.require_manifest([Item("a", "nowhere", ">", 1.0)], ["x"])


def test_published_display_labels(spark):
    # Source feature, operator, threshold, and its labels; all others keep their item's name.
    cases = [
        ("FEATURE_Age_Over60", "==", 1.0, "Age > 60 years", "年龄 > 60岁"),
        ("VEH_意识到危险前的初始速度_V0", ">", 50.0, "Initial speed > 50 km/h", "初始速度 > 50 km/h"),
        ("VEH_车高_HOEHE", ">", 1495.0, "Vehicle height > 1495 mm", "车辆高度 > 1495 mm"),
        ("VEH_车长_LAENGE", ">", 4598.5, "Vehicle length > 4598.5 mm", "车辆长度 > 4598.5 mm"),
        ("VEH_碰撞时的总重_GEWGES", ">", 1497.5, "Vehicle total weight > 1497.5", "车辆总重 > 1497.5"),
        ("性别_GESCHL_3-男性", "==", 1.0, "Male", "男性"),
        ("体重估计_GEWPG", ">", 70.0, "item", "item"),
        ("VEH_碰撞速度_VK", None, None, "item", "item"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "source string, op string, t double")
    each = [taxonomy.display_label(F.col("source"), F.lit("item"), F.col("op"), F.col("t"), x) for x in taxonomy.LANGUAGES]
    assert [tuple(r) for r in df.select(*each).collect()] == [c[3:] for c in cases]


def test_rule_labels(spark):
    df = spark.createDataFrame([(["light", "speed_v0"], evidence.CORE), (["other"], None), (["weather", "bio"], evidence.EXPLORATORY)], "families array<string>, tier string")
    got = df.select(taxonomy.interpretation(F.col("families")), evidence.strength_label(F.col("tier")), evidence.manuscript_place(F.col("tier"))).collect()
    assert tuple(got[0]) == ("speed management and conflict-speed reduction; lighting or night-visibility treatment", "priority governance target", "can enter main result discussion")
    assert tuple(got[1]) == (taxonomy.NO_ACTION, evidence.NO_STRENGTH, evidence.NO_PLACE)
    assert got[2][0] == "surface-friction and adverse-weather countermeasures; VRU vulnerability-sensitive protection"
    roles = spark.createDataFrame([(1, 0, 0, 0, 0), (0, 0, 2, 0, 0), (0, 0, 0, 3, 0), (0, 0, 0, 0, 4), (0, 0, 0, 0, 0)], "a int, b int, c int, d int, e int")
    found = [r[0].split()[0] for r in roles.select(evidence.coverage_role(*(F.col(c) for c in "abcde"))).collect()]
    assert found == ["confirmed", "replayable", "hypothesis-generating", "present", "not"]
    sizes = spark.createDataFrame([(1, 9, 0.1, 25), (0, 5001, 0.1, 25), (0, 9, 0.5, 25), (0, 9, 0.1, 25), (0, 9, 0.1, 20)], "m int, t int, h double, n int")
    found = [r[0].split("_")[0] for r in sizes.select(evidence.complexity_class(*(F.col(c) for c in "mthn"))).collect()]
    assert found == ["undercovered", "higher", "higher", "primary", "sensitivity"]
