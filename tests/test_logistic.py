"""Logistic models of all penalties and folds side by side are those of single fits."""
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from equigroup.operators import logistic, models

X = ["a", "b", "c0", "c1", "same"]


def table(spark, classes, n=900, folds=3):
    """Two numbers, two columns that add up to 1, and one that does not vary."""
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(5, 3, n), rng.exponential(0.01, n), rng.integers(0, 2, n)
    margin = 0.4 * (a - 5) + 90 * b + c + rng.logistic(0, 1.5, n)
    y = np.digitize(margin, np.quantile(margin, np.linspace(0, 1, classes + 1)[1:-1]))
    rows = [(i, float(a[i]), float(b[i]), int(c[i]), 1 - int(c[i]), 7.3, int(y[i]), int(rng.integers(0, folds))) for i in range(n)]
    return spark.createDataFrame(rows, "k int, a double, b double, c0 int, c1 int, same double, y int, fold int").repartition(7)


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_weights_and_hits_are_those_of_single_fits(spark, classes):
    d = models._label(table(spark, classes), "y").persist()
    penalties = [1e-2, 1e-3, 1e-6]
    accuracy, weights = logistic.side_by_side(d, X, "fold", penalties, 3, classes)
    assembler = VectorAssembler(inputCols=X, outputCol="features")
    for i, f in ((0, 0), (1, 1), (2, 2), (0, 2)):
        fitted = LogisticRegression(regParam=penalties[i], maxIter=2000, tol=1e-14).fit(assembler.transform(d.where(f"fold <> {f}")))
        want = np.column_stack([fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()])
        got = weights[i, f][classes == 2:]
        got = got - (np.append(np.zeros(len(X)), got[:, -1].mean() if classes > 2 else 0.0))
        probe = np.column_stack([np.array(d.select(*X).collect(), dtype=float), np.ones(900)])
        # the weights of columns that add up to a constant are only held by the penalty
        assert np.abs(probe @ (got - want).T).max() < 2e-3
        hits = fitted.transform(assembler.transform(d.where(f"fold = {f}"))).selectExpr("avg(IF(prediction = label, 1, 0))").first()[0]
        assert accuracy[i, f] == pytest.approx(hits, abs=1e-12)
    d.unpersist()


def test_tuning_of_many_rows_reads_them_for_all_models_at_once(spark, monkeypatch):
    d = table(spark, 3)
    want = models.tune(d, "LogisticRegression", X, "y", "fold", n_iter=5)
    monkeypatch.setattr(models, "SIDE_ROWS", 500)
    fits, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: (fits.append(1), fit(self, df, *a))[1])
    got = models.tune(d, "LogisticRegression", X, "y", "fold", n_iter=5)
    assert len(fits) == 1  # the best candidate on all rows
    assert [r["mean_accuracy"] for r in got[2].orderBy("candidate").collect()] == pytest.approx(
        [r["mean_accuracy"] for r in want[2].orderBy("candidate").collect()], abs=2.5 / 900)
    assert got[1] in models.draw_candidates("LogisticRegression", 5)


def test_what_does_not_fit_is_fitted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(models, "SIDE_ROWS", 50)
    d = spark.range(300).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id >= 150 AS INT) AS y", "CAST(id % 3 AS INT) AS fold")
    alone = d.selectExpr("a", "IF(y = 1 AND fold > 0, 0, y) AS y", "fold")  # beside fold 0 there is one class
    for some in (d, alone):
        assert len(models.tune(some, "LogisticRegression", ["a"], "y", n_iter=2, refit=False)[2].collect()) == 2
    monkeypatch.setattr(logistic, "MOST", 100)
    assert logistic.side_by_side(models._label(d, "y"), ["a"], "fold", [0.1], 3, 2) is None


def test_a_row_without_a_value_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(models, "SIDE_ROWS", 50)
    d = table(spark, 2)
    for bad in ("IF(k = 5, null, a) AS a, y", "IF(k = 5, CAST('NaN' AS DOUBLE), a) AS a, y", "a, IF(k = 5, null, y) AS y", "a, IF(k = 5, -1, y) AS y"):
        with pytest.raises(Exception):
            models.tune(d.selectExpr("k", "b", "fold", *bad.rsplit(", ", 1)), "LogisticRegression", ["a", "b"], "y", n_iter=1)


def test_a_feature_constant_beside_a_fold_has_no_weight(spark):
    d = models._label(table(spark, 3), "y").selectExpr("a", "b", "IF(fold = 1, a * b, 2.5D) AS own", "label", "fold").persist()
    accuracy, weights = logistic.side_by_side(d, ["a", "b", "own"], "fold", [1e-3], 3, 3)
    assert np.isfinite(accuracy).all() and (weights[0, 1, :, 2] == 0).all() and (weights[0, 0, :, 2] != 0).all()
    assembler = VectorAssembler(inputCols=["a", "b", "own"], outputCol="features")
    fitted = LogisticRegression(regParam=1e-3, maxIter=2000, tol=1e-14).fit(assembler.transform(d.where("fold <> 1")))
    assert fitted.coefficientMatrix.toArray() == pytest.approx(weights[0, 1, :, :-1], abs=1e-3, rel=1e-3)
    d.unpersist()
