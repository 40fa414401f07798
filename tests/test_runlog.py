import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from equigroup.operators import reports as R
from equigroup.sources import runlog
from equigroup.vocab import FAIRNESS_KEYS, PERFORMANCE_KEYS


def _names(spark, names, parse):
    d = spark.createDataFrame([(n,) for n in names], "file_name string")
    return {r["file_name"]: (r["dataset"], r["model"], r["grouping"]) for r in parse(d).collect()}


def test_parse_performance_names(spark):
    got = _names(spark, [
        "performance_metrics_Grouped_Heart_disease_MLP_kplus_run3.json",
        "performance_metrics_Ungrouped_Breast_cancer_SVM_ungrouped_run2.json",
        "performance_metrics_Grouped_breast_CANCER_LogisticRegression_group_dissimilar_run1.json",
        "performance_metrics_Grouped_Heart_disease_MLP_ungrouped_run3.json",
        "performance_metrics_Grouped_Lung_cancer_MLP_random_run3.json",
        "performance_metrics_Grouped_Obesity_MLP_random.json",
        "fairness_metrics_Obesity_MLP_random_run1.json",
    ], runlog.parse_performance_names)
    assert got["performance_metrics_Grouped_Heart_disease_MLP_kplus_run3.json"] == ("Heart Disease", "MLP", "K-plus")
    assert got["performance_metrics_Ungrouped_Breast_cancer_SVM_ungrouped_run2.json"] == \
        ("Breast Cancer", "SVM", "Ungrouped")
    assert got["performance_metrics_Grouped_breast_CANCER_LogisticRegression_group_dissimilar_run1.json"] == \
        ("Breast Cancer", "LogisticRegression", "Greedy")
    for bad in ["performance_metrics_Grouped_Heart_disease_MLP_ungrouped_run3.json",
                "performance_metrics_Grouped_Lung_cancer_MLP_random_run3.json",
                "performance_metrics_Grouped_Obesity_MLP_random.json",
                "fairness_metrics_Obesity_MLP_random_run1.json"]:
        assert got[bad] == (None, None, None)


def test_read_run_files_and_reports(spark):
    root = tempfile.mkdtemp(prefix="equigroup-runs-")
    os.makedirs(os.path.join(root, "sub"))
    perf = [("performance_metrics_Grouped_Heart_disease_MLP_kplus_run1.json", 0.5, 0.4, 0.3),
            ("performance_metrics_Grouped_Heart_disease_SVM_kplus_run2.json", 0.7, 0.0, 0.2),
            ("performance_metrics_Ungrouped_Obesity_SVM_ungrouped_run2.json", 0.9, 0.8, 0.85)]
    for name, acc, prec, f1 in perf:
        with open(os.path.join(root, "sub", name), "w") as fh:
            json.dump([{"Model": "x", "Accuracy": acc, "Precision": prec, "F1-score": f1, "ROC AUC": None}], fh,
                      indent=4)
    with open(os.path.join(root, "performance_metrics_Grouped_Obesity_MLP_random_run1.json"), "w") as fh:
        fh.write("{not json")
    with open(os.path.join(root, "fairness_metrics_Heart_disease_MLP_random_run1.json"), "w") as fh:
        fh.write('{"Disparate Impact": NaN, "Equal Opportunity": 0.25, "Equalized Odds": 1e-9, '
                 '"Predictive Parity": 0.5, "N-Sigma (ErrorRate)": 0.0, "Average distance from origin": 0.1}')
    files = runlog.read_run_files(spark, root, "performance_metrics_*.json")
    rec = runlog.performance_records(files)
    cnt = runlog.skipped_count(rec).first()
    assert (cnt["parsed"], cnt["skipped"]) == (3, 1)
    good = R.with_recall(rec.filter("ok"))
    rep = {(r["metric"], r["grouping"]): r for r in R.pivot_report(good, PERFORMANCE_KEYS).collect()}
    assert rep[("Accuracy", "K-plus")]["Heart Disease"] == pytest.approx(0.6)
    assert rep[("Precision", "K-plus")]["Heart Disease"] == pytest.approx(0.4)   # the 0.0 is dropped
    fair = runlog.fairness_records(runlog.read_run_files(spark, root, "fairness_metrics_*.json"))
    frep = {(r["metric"], r["grouping"]): r for r in R.pivot_report(fair.filter("ok"), FAIRNESS_KEYS, 1e-8).collect()}
    assert frep[("Disparate Impact", "Random")]["Heart Disease"] is None        # NaN dropped
    assert frep[("Equalized Odds", "Random")]["Heart Disease"] is None          # tiny dropped
    assert frep[("Equal Opportunity", "Random")]["Heart Disease"] == pytest.approx(0.25)
    js = {r["metric"]: json.loads(r["json"]) for r in R.summary_json(R.pivot_report(good, PERFORMANCE_KEYS),
                                                                     PERFORMANCE_KEYS).collect()}
    assert list(js["Accuracy"]) == ["Ungrouped", "K-plus"]
    assert js["Accuracy"]["K-plus"] == {"Heart Disease": pytest.approx(0.6)}


def test_benchmark_csv_and_writers(spark):
    root = tempfile.mkdtemp(prefix="equigroup-bench-")
    path = os.path.join(root, "bench.csv")
    with open(path, "w") as fh:
        fh.write("Model,Min (%),Mean (%),Max (%)\nLogistic Regression,91.555,95.503,98.576\n")
    b = runlog.load_benchmark_csv(spark, path).first()
    assert (b["model"], b["min"], b["mean"], b["max"]) == ("Logistic Regression", 91.555, 95.503, 98.576)
    with open(os.path.join(root, "bad.csv"), "w") as fh:
        fh.write("Name,Low\nx,1\n")
    with pytest.raises(ValueError):
        runlog.load_benchmark_csv(spark, os.path.join(root, "bad.csv"))
    df = spark.createDataFrame([(0.5, 0.25)], "Accuracy double, `F1-score` double")
    runlog.save_metrics(df, os.path.join(root, "metrics"), run_id=3)
    back = spark.read.json(os.path.join(root, "metrics"))
    assert back.filter(F.col("run_id") == 3).count() == 1
    runlog.save_csv(df, os.path.join(root, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(root, "csv")).columns == ["Accuracy", "F1-score"]


def test_overlay_shapes_keep_missing(spark):
    means = spark.createDataFrame([("Logistic Regression", "Random", 0.9), ("Xgboost Classification", "Random", 0.8),
                                   ("Xgboost Classification", "Greedy", 0.70001)],
                                  "model string, grouping string, value double")
    long = R.overlay_long(means)
    arr = {r["grouping"]: r["values_pct"] for r in R.overlay_arrays(long).collect()}
    # model order: Xgboost first, Logistic Regression last; missing cells stay NULL
    assert arr["Random"] == [80.0, 90.0]
    assert arr["Greedy"] == [70.001, None]
    assert arr["Ungrouped"] == [None, None]
    assert len(arr) == 6


def test_file_safe_metric_names(spark):
    d = spark.createDataFrame([("N-Sigma (ErrorRate)",), ("F1-score",), ("Disparate Impact",)], "m string")
    fair = [r[0] for r in d.select(R.file_safe(F.col("m"), fairness=True)).collect()]
    perf = [r[0] for r in d.select(R.file_safe(F.col("m"))).collect()]
    assert fair == ["N_Sigma_ErrorRate", "F1_score", "Disparate_Impact"]
    assert perf == ["N-Sigma_(ErrorRate)", "F1-score", "Disparate_Impact"]
