import pytest
from pyspark.sql import functions as F

from equigroup.functions.columns import privileged
from equigroup.operators import fairness as FA
from equigroup.operators import metrics as V


def test_macro_scores_golden(spark):
    d = spark.createDataFrame(list(zip([0, 0, 1, 1, 2], [0, 1, 1, 1, 0])), "y int, p int")
    r = V.macro_scores(d, "y", "p").first()
    assert r["macro_f1"] == pytest.approx(0.4333333, abs=1e-7)
    assert r["macro_precision"] == pytest.approx(0.3888889, abs=1e-7)


def test_auc_midranks(spark):
    d = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0.1, 0.4, 0.4, 0.4, 0.9])), "y int, s double")
    assert V.roc_auc(d, "y", "s").first()["roc_auc"] == pytest.approx(0.8333333, abs=1e-7)
    d3 = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.3)], "y int, s double")
    assert V.roc_auc(d3, "y", "s").first()["roc_auc"] is None


def test_recall_from_precision_f1(spark):
    d = spark.createDataFrame([(0.9863013698630136, 0.9811507936507937), (0.0, 0.5)], "p double, f double")
    r = d.select(V.recall_from(F.col("p"), F.col("f")).alias("r")).collect()
    assert r[0]["r"] == pytest.approx(0.9760537317524504, abs=1e-12)
    assert r[1]["r"] is None


def _fair(spark, swap=False):
    priv = [(1, 1), (1, 0), (0, 0), (0, 1)]
    other = [(1, 1), (0, 0), (0, 0), (1, 0)]
    rows = [(t, p, "a" if not swap else "b") for t, p in priv] + [(t, p, "b" if not swap else "a") for t, p in other]
    return spark.createDataFrame(rows, "y int, p int, s string")


def test_fairness_golden(spark):
    d = _fair(spark)
    r = FA.fairness_record(d, "y", "p", privileged(F.col("s"), "a")).first()
    assert r["Disparate Impact"] == pytest.approx(0.5)
    assert r["Equal Opportunity"] == pytest.approx(0.0, abs=1e-9)
    assert r["Equalized Odds"] == pytest.approx(0.4999998, abs=1e-7)
    assert r["Predictive Parity"] == pytest.approx(0.4999992, abs=1e-7)
    assert r["N-Sigma (ErrorRate)"] == pytest.approx(0.4629099, abs=1e-7)


def test_disparate_impact_swap_is_reciprocal(spark):
    a = FA.fairness_record(_fair(spark), "y", "p", privileged(F.col("s"), "a")).first()["Disparate Impact"]
    b = FA.fairness_record(_fair(spark), "y", "p", privileged(F.col("s"), "b")).first()["Disparate Impact"]
    assert a * b == pytest.approx(1.0)


def test_null_sensitive_is_unprivileged(spark):
    d = spark.createDataFrame([(1, 1, None), (1, 1, "a"), (0, 1, "a")], "y int, p int, s string")
    rates = {r["privileged"]: r["n"] for r in FA.group_rates(d, "y", "p", privileged(F.col("s"), "a")).collect()}
    assert rates == {True: 2, False: 1}
