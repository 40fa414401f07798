"""Boosted trees on counted cells, and scoring by cell."""
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from equigroup.operators import models

FEW_TREES = {"n_estimators": 3, "max_depth": 3}


def table(spark, n=600, classes=3, seed=5):
    """Features of 8 and 5 values, the label drawn by them."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 8, n) * 1.5 - 2.0, rng.integers(0, 5, n)
    y = (a + b + rng.normal(0, 2, n) > 2).astype(int) + ((b > 2) & (rng.random(n) > 0.4)) * (classes - 2)
    return spark.createDataFrame([(i, float(a[i]), int(b[i]), int(y[i])) for i in range(n)], "k int, a double, b int, y int").repartition(5)


def scores(fitted, d):
    return {r["k"]: (r["prediction"], r["p1"]) for r in models.predict(fitted, d).select("k", "prediction", "p1").collect()}


@pytest.fixture
def fitted_rows(monkeypatch):
    """The rows that each pipeline with trees is fitted on."""
    out, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: (out.append(df.count()), fit(self, df, *a))[1])
    return out


@pytest.mark.parametrize("classes", [2, 3])
def test_trees_on_counted_cells_are_those_of_the_rows(spark, monkeypatch, fitted_rows, classes):
    d = table(spark, classes=classes)
    # values beside and between those of the fit
    probe = spark.range(400).selectExpr("CAST(id AS INT) AS k", "id % 20 * 0.7D - 3.1D AS a", "CAST(id DIV 20 % 6 AS INT) AS b")
    by_rows = models.fit(d, "XGBoost", ["a", "b"], "y", FEW_TREES)
    monkeypatch.setattr(models, "CELL_ROWS", 200)
    by_cells = models.fit(d, "XGBoost", ["a", "b"], "y", FEW_TREES)
    assert fitted_rows == [600, 600, d.select("a", "b", "y").distinct().count()]
    want = scores(by_rows, probe)
    assert len(want) == 400 and len({p for p, _ in want.values()}) == classes
    for found in (scores(by_cells, probe), {r["k"]: (r["prediction"], want[r["k"]][1]) for r in by_cells.transform(probe).collect()}):
        assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
        assert [found[k][1] for k in sorted(want)] == pytest.approx([want[k][1] for k in sorted(want)])


def test_rows_drawn_at_random_and_wide_tables_are_fitted_row_by_row(spark, monkeypatch, fitted_rows):
    monkeypatch.setattr(models, "CELL_ROWS", 50)
    models.fit(table(spark), "XGBoost", ["a", "b"], "y", {**FEW_TREES, "subsample": 0.8})
    models.fit(table(spark).limit(100), "XGBoost", ["a", "b"], "y", FEW_TREES)  # 40 bins of 3 classes
    assert fitted_rows[0] == 600 and fitted_rows[-1] == 100


def test_cuts_are_even_and_know_all_rows(spark):
    d = spark.range(0, 20_000, 1, 7).selectExpr("id % 9973 / 7D AS wide", "IF(id % 10 > 0, 0D, CAST(id AS DOUBLE)) AS heavy",
                                                "IF(id = 77, 5, id % 2) AS rare", "1 AS same", "id % 50 AS fifty")
    wide, heavy, rare, same, fifty = models.feature_cuts(d, d.columns)
    for cuts, c, within in ((wide, "wide", (550, 700)), (heavy, "heavy", (40, 18_001))):
        places = [r["count"] for r in d.selectExpr(f"{models._place(c, cuts)} AS p").groupBy("p").count().collect()]
        assert len(places) == models.BINS and within[0] <= min(places) and max(places) <= within[1]
    assert (rare, same) == ([0.0, 1.0], []) and models.BINS - 3 <= len(fifty) < models.BINS


def test_a_model_of_bins_is_saved_and_loaded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(models, "CELL_ROWS", 200)
    d = table(spark)
    fitted = models.fit(d, "XGBoost", ["a", "b"], "y", FEW_TREES)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    assert scores(PipelineModel.load(str(tmp_path / "m")), d) == scores(fitted, d)
    with pytest.raises(Exception):
        models.predict(fitted, spark.createDataFrame([(1, None, 2)], "k int, a double, b int")).collect()
