"""Edge cases listed in SURVEY section 5: constant and all-null columns,
empty privileged group, single class, multi-class targets."""

import pytest
from pyspark.sql import functions as F

from equigroup.functions.columns import privileged
from equigroup.operators import fairness as FA
from equigroup.operators import info, metrics as V, prep


def test_constant_column(spark):
    d = spark.createDataFrame([(i % 3, 7, i % 2) for i in range(30)], "a int, c int, t int")
    h = {r["feature"]: r["entropy"] for r in info.entropy(d, ["a", "c"]).collect()}
    assert h["c"] == pytest.approx(0.0, abs=1e-12)
    m = info.dissimilarity(d, ["a", "c"], "t", with_parts=True).first()
    assert m["cmi"] == pytest.approx(0.0, abs=1e-12) and m["dissimilarity"] == pytest.approx(1.0, abs=1e-9)
    assert [r["feature"] for r in prep.non_constant_features(d, ["a", "c"]).collect()] == ["a"]


def test_all_null_column(spark):
    d = spark.createDataFrame([(i % 3, None, i % 2) for i in range(30)], "a int, b int, t int")
    assert info.conditional_mutual_information(d, ["a", "b"], "t").count() == 0
    h = {r["feature"]: r for r in info.entropy(d, ["a", "b"]).collect()}
    assert "b" not in h and h["a"]["n"] == 30


def test_empty_privileged_group(spark):
    d = spark.createDataFrame([(1, 1, "x"), (0, 1, "x"), (1, 0, "y")], "y int, p int, s string")
    r = FA.fairness_record(d, "y", "p", privileged(F.col("s"), "nobody")).first()
    assert r["Disparate Impact"] is None and r["Equal Opportunity"] is None


def test_multiclass_rates_use_only_binary_rows(spark):
    d = spark.createDataFrame([(2, 2, "a"), (2, 0, "a"), (1, 1, "a"), (0, 0, "b"), (1, 0, "b")],
                              "y int, p int, s string")
    rates = {r["privileged"]: r for r in FA.group_rates(d, "y", "p", privileged(F.col("s"), "a")).collect()}
    assert rates[True]["tp"] == 1 and rates[True]["fn"] == 0 and rates[True]["n"] == 3
    assert rates[False]["fn"] == 1 and rates[False]["tn"] == 1


def test_single_class_metrics(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2)], "y int, p int, s double")
    rec = V.metric_record(d, "y", "p", "s", "m").first()
    assert rec["ROC AUC"] is None
    assert rec["Accuracy"] == pytest.approx(0.5)
    # labels seen only in predictions count in the macro mean (precision 0 there)
    assert rec["Precision"] == pytest.approx(0.5)
