"""Fits run over as many partitions as the rows fill, whatever was shuffled before."""
import numpy as np
import pytest
from pyspark.ml import Pipeline

from equigroup.operators import models


@pytest.fixture
def seen(monkeypatch):
    """The partitions and rows of each table that a pipeline is fitted on."""
    out, fit = [], Pipeline.fit

    def noted(self, df, *args):
        out.append((df.rdd.getNumPartitions(), df.count()))
        return fit(self, df, *args)

    monkeypatch.setattr(Pipeline, "fit", noted)
    return out


def points(spark, n=120):
    rows = [(i, float(i % 7), float(i % 3), int(i * i % 11 > 4), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "k int, a double, b double, y int, fold int").repartition(40)


def test_a_small_table_is_fitted_in_one_partition(spark, seen, monkeypatch):
    models.fit(points(spark), "LogisticRegression", ["a", "b"], "y")
    assert seen == [(1, 120)]
    monkeypatch.setattr(models, "FIT_ROWS", 30)
    models.fit(points(spark), "LogisticRegression", ["a", "b"], "y")
    assert seen[-1] == (4, 120)


def test_tuning_scales_once_a_fold_and_fits_every_candidate(spark, seen):
    d = points(spark)
    _, params, table = models.tune(d, "LogisticRegression", ["a", "b"], "y", "fold", n_iter=4)
    # scaling of 3 folds, 4 candidates on each, the best one on all rows
    assert sorted(seen) == [(1, 80)] * 15 + [(1, 120)]
    cands = models.draw_candidates("LogisticRegression", 4)
    want = []
    for c in cands:
        hits = []
        for f in range(3):
            held = d.where(f"fold = {f}")
            m = models.build_pipeline("LogisticRegression", ["a", "b"], c, 2, 120).fit(d.where(f"fold <> {f}").withColumnRenamed("y", "label"))
            hits.append(m.transform(held).where("prediction = y").count() / held.count())
        want.append(float(np.mean(hits)))
    assert [r["mean_accuracy"] for r in table.orderBy("candidate").collect()] == pytest.approx(want)
    assert params == cands[int(np.argmax(want))]


@pytest.mark.parametrize("model, jobs", [("LogisticRegression", 3), ("RandomForest", 6)])
def test_candidates_of_weights_are_scored_by_one_job_a_fold(spark, monkeypatch, model, jobs):
    calls, measure = [], models.accuracies
    monkeypatch.setattr(models, "accuracies", lambda found, held: (calls.append(len(found)), measure(found, held))[1])
    monkeypatch.setattr(models, "draw_candidates", lambda m, n, seed: [{"C": 1.0, "n_estimators": 2, "max_depth": 2}, {"C": 0.1, "n_estimators": 1, "max_depth": 1}])
    best, _, table = models.tune(points(spark), model, ["a", "b"], "y", "fold", refit=False)
    assert best is None and len(calls) == jobs and sum(calls) == 6 and table.count() == 2


def test_side_by_side_fits_have_larger_partitions(spark, seen, monkeypatch):
    monkeypatch.setattr(models, "FIT_ROWS", 20)
    models.tune(points(spark), "LogisticRegression", ["a", "b"], "y", "fold", n_iter=1, refit=False)
    assert seen and {n for n, _ in seen} == {1}
    monkeypatch.setattr(models, "TUNE_CELLS", 60)  # 30 rows of two values
    models.tune(points(spark), "LogisticRegression", ["a", "b"], "y", "fold", n_iter=1, refit=False)
    assert seen[-1][0] == 4


def test_the_flow_goes_on_in_few_partitions(spark, monkeypatch):
    from equigroup.operators import experiment
    found = []
    monkeypatch.setattr(experiment, "tuned_params", lambda train, *a: (found.append(train.rdd.getNumPartitions()), {"C": 1.0})[1])
    out = experiment.run_experiment(points(spark), points(spark, 30), "k", "LogisticRegression", ["a", "b"], "y")
    assert found == [1] and out.count() == 1


def test_folds_must_all_have_rows(spark):
    for bad in ("IF(fold = 1, 0, fold)", "-1", "0", "CAST(null AS int)"):
        with pytest.raises(Exception):
            models.tune(points(spark, 30).selectExpr("a", "b", "y", f"{bad} AS fold"), "LogisticRegression", ["a"], "y", n_iter=1)


def test_repeated_folds_are_fitted_in_few_partitions_and_measured_at_once(spark, seen, monkeypatch):
    from equigroup.operators import experiment, metrics
    scored, measure = [], experiment.fold_metrics
    monkeypatch.setattr(experiment, "fold_metrics", lambda pred, *a: (scored.append(pred), measure(pred, *a))[1])
    got = {(r["repeat"], r["fold"]): r for r in experiment.repeated_kfold(points(spark), "k", "LogisticRegression", ["a", "b"], "y", k=2, repeats=1).collect()}
    assert len(got) == 2 and seen == [(1, 60)] * 2 and len(scored) == 1
    for (r, f), row in got.items():
        one = metrics.metric_record(scored[0].where(f"repeat = {r} AND fold = {f}"), "y", "prediction", "p1", "m").first()
        assert [row[c] for c in ("accuracy", "f1_score", "precision", "roc_auc")] == pytest.approx(
            [one[c] for c in ("Accuracy", "F1-score", "Precision", "ROC AUC")])


def test_attributions_and_percentiles_are_kept_in_few_partitions(spark, monkeypatch):
    from equigroup.functions import quantiles
    from equigroup.operators import experiment
    seen, few = [], 2 * spark.sparkContext.defaultParallelism
    keep = experiment.materialize

    def noted(df):
        out = keep(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    for module in (experiment, models, quantiles):
        monkeypatch.setattr(module, "materialize", noted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        monkeypatch.setattr(models, "draw_candidates", lambda *a: [{"C": 1.0}])
        d = points(spark, 60).coalesce(3)
        out = experiment.run_experiment(d, d, "k", "LogisticRegression", ["a", "b"], "y", mode="each_label").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(out) == 1 and len(seen) >= 7 and max(seen) <= max(16, few)
