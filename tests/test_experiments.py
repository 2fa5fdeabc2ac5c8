import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import experiments as ex
from tessera.plans.standins import vectors

DATA = "/root/testdata/sf0.001"


def test_groups():
    want = {"med_has_x": "medications", "has_procgrp_1": "procedures", "has_cond_E11": "diagnosis_flags", "2017Q1_cost": "cost_features", "total_claims": "utilization", "SEX": "demographics", "essex": "other"}
    assert {c: names.group_of(c) for c in want} == want
    assert names.grouped_names(["a", "med_b"]) == {"other": ["a"], "medications": ["med_b"]}


def test_feature_sets(spark):
    cols = ["enrolid", "has_Dorsopathies", "has_Obesity", "has_cost_increasing", "total_claims_2017", "cost_2017", "cost_2018", "AGEGRP"]
    flags = [c for c in cols if c.startswith("has_")]
    assert names.phenotype_names(cols, flags) == ["has_Dorsopathies", "has_Obesity"]
    assert names.matching_names(cols, ["AGEGRP"], flags) == ["AGEGRP", "total_claims_2017", "cost_2017"]
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 0.0, 4.0, 1.0, 2.0, 3.0), (2.0, 0.0, None, 1.0, 9.0, 1.0, 2.0, 4.0)], ", ".join(f"{c} double" for c in cols))
    out, features = names.phenotype_features(df, flags, names.PRESETS[2])
    r = out.orderBy("enrolid").collect()
    assert features[-2:] == ["_za_intensity_log1p", "_za_age_continuous"]
    assert [x["_za_comorbidity_count"] for x in r] == [2, 0] and [x["_za_msk_flag_count"] for x in r] == [1, 0]
    assert r[0]["_za_intensity_log1p"] == pytest.approx(np.log1p(4)) and r[1]["_za_intensity_log1p"] == pytest.approx(np.log1p(np.percentile([4, 9], 99.5)))
    with pytest.raises(ValueError, match="preset"):
        names.phenotype_features(df, flags, "other")
    with pytest.raises(ValueError, match="cost_2018"):
        names.without_leakage(cols, [2018])


def test_target_picker(spark):
    df = spark.createDataFrame([(i, float(i), 1, 2) for i in range(101)], "enrolid int, annual_cost_2018_deflated double, has_x int, y_2018 int")
    out, target, features = names.target_and_features(df, [2018], 2)
    assert target == "top_2_pct_cost_2018" and features == ["has_x"] and out.agg(F.sum(target)).first()[0] == 3
    assert names.target_and_features(out, [2018, 2019], 2)[1] == "top_2_pct_cost_2018"
    with pytest.raises(ValueError, match="features"):
        names.target_and_features(df, [2018], 2, "nothing")
    labels = spark.createDataFrame([("top_0_5_pct_cost",), ("none",)], "t string")
    assert [r[0] for r in labels.select(names.label_percent("t")).collect()] == [0.5, None]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("static_lead_Ibpm", "Lead I: Heart Rate (bpm)"),
        ("static_lead_aVLhdist_pr_med", "Lead aVL: PR Interval Distance - Median"),
        ("static_lead_IIIvdist_st_max_x", "Lead III: ST Segment Voltage - Maximum (x)"),
        ("tsfresh_dim_0__fourier_entropy__bins_10_leadV3", "Lead V3: Fourier Entropy Bins 10 (Time Series)"),
        ("tsfresh_dim_1__mean", "Time Series: Mean"),
        ("ICD10__C50.919", "ICD-10: C50.919 - A tumour"),
        ("ICD_25000", "ICD-9: 250.00"),
        ("Medication__12", "Medication: Aspirin (Code: 12)"),
        ("med_99", "Medication Code: 99"),
        ("age_group", "Age Group"),
    ],
)
def test_readable(name, want):
    assert names.readable(name, {"C50919": "A tumour"}, {"12": "Aspirin"}) == want


def test_guards_and_alignment(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id int, x double")
    b = spark.createDataFrame([(2, 0.5), (3, 0.6)], "id int, y double")
    with pytest.raises(ValueError, match="overlap"):
        ex.disjoint(a, b, "id")
    with pytest.raises(ValueError, match="outside"):
        ex.contained(a, b, "id")
    assert ex.aligned(a, b, a.select("id"), "id").count() == 1
    assert [tuple(r) for r in ex.aligned_by_place(a.select("x"), b.select("y"), [F.col("x")], [F.col("y")]).orderBy("place").collect()] == [(0, 0.1, 0.5), (1, 0.2, 0.6)]
    assert ex.backfilled(a, b, "y", "id").orderBy("id").collect()[1].y == 0.5
    split = spark.createDataFrame([(1, "val"), (2, "train")], "id int, split string")
    tagged = spark.createDataFrame([(1, "val"), (1, "test"), (2, "train")], "id int, split string")
    assert [tuple(r) for r in ex.of_split(tagged, split, "id").collect()] == [(1, "val")]


def test_probit(spark):
    df = spark.createDataFrame([(p,) for p in (0.025, 0.5, 0.9)], "p double")
    assert [r[0] for r in df.select(ex.probit("p")).collect()] == pytest.approx([-1.95996, 0, 1.28155], abs=6e-4)


def test_curated_skips_without_majority(spark):
    v = vectors(spark, DATA)
    few = v.where("target = 1").unionByName(v.where("target = 0").limit(3))
    out = ex.curated(few)
    assert out["skipped_reason"] and out["controls"].count() == 3


def test_training_and_stability(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(a), float(b), int(a + 0.1 * b > 0.6)) for i, (a, b) in enumerate(rng.random((300, 2)))], "id int, a double, b double, y int")
    part = lambda k: df.where(F.col("id") % 3 == k)
    record = ex.trained_and_evaluated(part(0), part(1), part(2), ["a", "b"], "y", "id", maxDepth=2)
    assert record["test_auc"] > 0.9 and record["seconds"] > 0
    with pytest.raises(ValueError, match="overlap"):
        ex.trained_and_evaluated(df, part(1), part(2), ["a", "b"], "y", "id")
    assert ex.stable_features([["a", "b"], ["a", "b"], ["a", "c"]]) == pytest.approx((1 + 1 / 3 + 1 / 3) / 3)
    gaps = spark.createDataFrame([(0, 2.0)], "feature int, mean_gap double")
    assert ex.contribution_ratio(gaps, gaps).first().ratio == 1
    with pytest.raises(ValueError, match="metric"):
        ex.distances_for("other", df, df, df, {}, "id")
