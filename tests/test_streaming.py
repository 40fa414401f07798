import json
import os
import tempfile

import pytest

from equigroup.streaming.runlog_stream import start_report


def _write(root, name, acc):
    with open(os.path.join(root, name), "w") as fh:
        json.dump([{"Model": "m", "Accuracy": acc, "Precision": 0.5, "F1-score": 0.5, "ROC AUC": None}], fh)


def test_streaming_report_updates(spark):
    root = tempfile.mkdtemp(prefix="equigroup-stream-")
    ck = tempfile.mkdtemp(prefix="equigroup-stream-ck-")
    _write(root, "performance_metrics_Grouped_Heart_disease_MLP_kplus_run1.json", 0.5)
    q = start_report(spark, root, ck, query_name="perf_report_test")
    try:
        q.processAllAvailable()
        _write(root, "performance_metrics_Grouped_Heart_disease_SVM_kplus_run2.json", 0.7)
        _write(root, "performance_metrics_Grouped_Heart_disease_SVM_kplus_run3.json", 0.0)
        q.processAllAvailable()
        r = spark.sql("select * from perf_report_test where metric = 'Accuracy' and grouping = 'K-plus'").first()
        assert r["n"] == 2 and r["mean"] == pytest.approx(0.6)
    finally:
        q.stop()


def test_streaming_fairness_report(spark):
    root = tempfile.mkdtemp(prefix="equigroup-fstream-")
    ck = tempfile.mkdtemp(prefix="equigroup-fstream-ck-")
    with open(os.path.join(root, "fairness_metrics_Obesity_SVM_random_run1.json"), "w") as fh:
        fh.write('{\n "Disparate Impact": NaN,\n "Equal Opportunity": 0.2,\n "Equalized Odds": 1e-9,\n'
                 ' "Predictive Parity": 0.1,\n "N-Sigma (ErrorRate)": 0.3,\n "Average distance from origin": 0.4\n}')
    q = start_report(spark, root, ck, query_name="fair_report_test", kind="fairness")
    try:
        q.processAllAvailable()
        rows = {r["metric"]: r for r in spark.sql("select * from fair_report_test").collect()}
        assert rows["Equal Opportunity"]["mean"] == pytest.approx(0.2)
        assert rows["Disparate Impact"]["n"] == 0 and rows["Equalized Odds"]["n"] == 0
    finally:
        q.stop()
