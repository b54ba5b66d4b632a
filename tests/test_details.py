"""Powertrains, bounds by name, unobserved values, axis texts, validators, column names and package folders."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from evimine.functions import taxonomy, text
from evimine.operators import audit, evidence, prep
from evimine.sources import tables


def test_powertrain_of_five_texts(spark):
    rows = [
        ("纯电动", None, None, None, None), (None, "电动机", "汽油", "x", None), (None, None, "动力电池", None, None), ("增程式", None, None, None, None), (None, "混合动力", "汽油", None, None),
        (None, "汽油发动机", None, "0", "不适用"), (None, None, "柴油", "NaN", None), (None, None, None, "12.5", None), (None, None, None, None, "三元锂"), (None, None, None, None, None), ("", "", "", "-1", "未知"),
    ]
    df = spark.createDataFrame(rows, "k string, m string, f string, c string, b string").coalesce(1)
    got = [tuple(r) for r in df.select(*text.vehicle_power(*map(F.col, "kmfcb")).values()).collect()]
    assert got == [
        (1, 0, 1, "纯电/电驱"), (1, 0, 1, "纯电/电驱"), (1, 0, 1, "纯电/电驱"), (0, 1, 1, "混动/增程"), (0, 1, 1, "混动/增程"),
        (0, 0, 0, "燃油"), (0, 0, 0, "燃油"), (0, 0, 1, "未知"), (0, 0, 1, "未知"), (0, 0, 0, "未知"), (0, 0, 0, "未知"),
    ]
    none = F.lit(None).cast("string")
    assert df.select(text.vehicle_power(none, F.col("m"), none, none, none)["powertrain"].alias("p")).where("p = '燃油'").count() == 1
    assert df.where("false").select(*text.vehicle_power(*map(F.col, "kmfcb")).values()).count() == 0


def test_bounds_by_name_are_the_same_for_columns_and_single_names(spark):
    expected = {
        "VEH_V0": (0.0, 250.0), "vk": (0.0, 250.0), "VKREG": None, "VKREG_V0": (0.0, 250.0), "x车长": (300.0, 25000.0), "länge": (300.0, 25000.0), "TEMP_BREITE": (500.0, 3500.0),
        "HOEHE_V0": (500.0, 4500.0), "车宽": (500.0, 3500.0), "STOSSP": None, "碰撞角度": None, "other": None, "": None, "FEATURE_Age_Years": (0.0, 120.0),
    }
    names = spark.createDataFrame([(n,) for n in expected] + [(None,)], "n string")
    got = {r["n"]: r for r in names.select("n", *(c.alias(k) for k, c in prep.name_bounds(F.col("n")).items())).collect()}
    for n, bound in expected.items():
        assert prep.bound_of(n) == bound
        assert ((got[n]["lo"], got[n]["hi"]) if bound else None) == bound and (got[n]["lo"] is None) == (bound is None)
        assert got[n]["is_dimension"] == prep.is_vehicle_dimension(n) and got[n]["is_engineering"] == prep.is_engineering(n)
    assert tuple(got[None])[1:] == (None, None, False, False)
    assert prep.is_engineering("STOSSP") and prep.is_engineering("VKREG") and not prep.is_vehicle_dimension("V0") and not prep.is_engineering("other")


def test_unobserved_values_by_text_code_and_absence(spark):
    df = spark.createDataFrame([("12 km", "a"), (" 未知 ", "a"), ("99-未知", "b"), (None, "b"), ("words", "b"), ("999", "b"), ("-3.5", None)], "v string, g string").coalesce(1)
    assert [r["v"] for r in prep.observed_flags(df, {"v": (999.0,)}, ["g"]).collect()] == [0, 1, 1, 1, 1, 1, 0]
    got = {r["g"]: (r["n_rows"], r["n_sentinel"], r["n_missing_after"], round(r["sentinel_rate"], 3)) for r in prep.unobserved_audit(df, {"v": (999.0,)}, ["g"]).collect()}
    assert got == {"a": (2, 1, 1, 0.5), "b": (4, 2, 4, 0.5), None: (1, 0, 0, 0.0)}
    assert prep.unobserved_audit(df.where("false"), {"v": ()}, ["g"]).count() == 0


def test_axis_texts_of_known_unknown_and_null_axes(spark):
    df = spark.createDataFrame([("speed_energy",), ("vulnerability_body",), ("nothing",), (None,)], "axis string").coalesce(1)
    known, body, other, none = df.select(*(c.alias(n) for n, c in taxonomy.axis_context(F.col("axis")).items())).collect()
    assert known["domain"] == "speed management and conflict-speed reduction" and known["domain_place"] == 1 and known["mining_boundary"].startswith("Train-only mechanism label; interpret only")
    assert body["summary_boundary"].startswith("Evidence summary only; vulnerability/body-size") and body["template"].startswith("个体脆弱性-体格轴线")
    assert other == none and other["domain_place"] == 14 and other["scene"].startswith("cross-mechanism") and other["summary_boundary"].startswith("Evidence summary only; does not modify")
    labels = {a for a, _, _ in taxonomy.AXES} | {"mixed_multimechanism"}
    assert labels == set(taxonomy.SCENES) == set(taxonomy.TEMPLATES) == set(taxonomy.DOMAINS)


def test_validators_name_what_is_wrong(spark):
    items = spark.createDataFrame([("a", "not_missing_category"), ("b", "pure_missing_unknown"), ("c", None)], "item string, missing string")
    with pytest.raises(audit.ChecksFailed, match="only say missing: b$"):
        audit.require_known_items(items)
    assert audit.require_known_items(items.where("item <> 'b'")).count() == 2
    with pytest.raises(audit.ChecksFailed, match="lacks missing"):
        audit.require_known_items(items.drop("missing"))
    graded = spark.createDataFrame([("r1", evidence.CORE), ("r2", evidence.REPLAYABLE), ("r3", evidence.STATISTICAL), (None, evidence.CORE)], "rule string, tier string")
    tiers = (evidence.CORE, evidence.REPLAYABLE)
    whole = graded.where("tier <> 'none'").where(F.col("tier").isin(*tiers))
    assert audit.require_membership(graded, whole, "rule", tiers).count() == 3
    assert audit.require_membership(graded.where("false"), whole.where("false"), "rule", tiers).count() == 0
    wrong = graded.where("rule IN ('r1', 'r3')")
    assert tuple(audit.table_membership(graded, wrong.union(wrong), "rule", tiers).first()) == (3, 2, 2, 1, "FAIL")
    with pytest.raises(audit.ChecksFailed, match="2 rules missing, 1 too many"):
        audit.require_membership(graded, wrong, "rule", tiers)


def test_headers_lose_white_space(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" key ,b\t, c d\n1,2,3\n", encoding="utf-8")
    assert tables.read_csv(spark, str(tmp_path / "a.csv")).columns == ["key", "b", "c d"]


def test_package_folder_with_index(tmp_path):
    (tmp_path / "Rule_a.csv").write_text("x")
    (tmp_path / "07_Run_Manifest.json").write_text('{"outputs": ["out/Rule_a.csv", "Gone.csv"]}')
    files = [str(tmp_path / n) for n in ("Rule_a.csv", "07_Run_Manifest.json", "Gone.csv")]
    archive, folder = str(tmp_path / "p.zip"), str(tmp_path / "package")
    assert tables.package(files, archive) == [files[2]]
    assert tables.verify_package(archive, files[:2], [files[1], "none.json"]) == [("required", "PASS", 2, []), ("07_Run_Manifest.json", "FAIL", 2, ["Gone.csv"]), ("none.json", "PASS", 0, [])]
    for _ in range(2):  # an earlier package is replaced
        rows = tables.package_folder(files, folder, archive, lambda n: "rules" if n.startswith("Rule") else "other")
        assert sorted(os.listdir(folder)) == [tables.INDEX, "07_Run_Manifest.json", "Rule_a.csv"]
    with open(os.path.join(folder, tables.INDEX), encoding="utf-8-sig") as f:
        index = list(csv.DictReader(f))
    assert [(r["File"], r["Category"], r["Exists"], r["Size_Bytes"], r["Included_In_Zip"], r["Notes"]) for r in index] == [("Rule_a.csv", "rules", "True", "1", "True", ""), ("07_Run_Manifest.json", "other", "True", str(rows[1]["Size_Bytes"]), "True", ""), ("Gone.csv", "other", "False", "0", "False", "missing")]
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "note").write_text("keep")
    with pytest.raises(ValueError, match="something else"):
        tables.package_folder(files, str(tmp_path / "mine"), archive, str)
    assert (tmp_path / "mine" / "note").read_text() == "keep"
    with pytest.raises(ValueError, match="several files"):
        tables.package_folder([files[0], str(tmp_path / "sub" / "Rule_a.csv")], folder, archive, str)
    with pytest.raises(ValueError, match="is replaced"):
        tables.package_folder([os.path.join(folder, "Rule_a.csv")], folder, archive, str)
