"""Rows that used to get lost or to break a result."""
import os
import subprocess
import sys

import pytest

from equigroup.operators import kernels, metrics, models, reports


def test_auc_leaves_out_rows_without_truth_or_score(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.1), (None, 0.4), (0, None)], "y int, s double")
    assert metrics.roc_auc(d, "y", "s").first()[0] == 1.0
    one = spark.createDataFrame([(1, 0.9), (None, 0.4)], "y int, s double")
    assert metrics.roc_auc(one, "y", "s").first()[0] is None


def test_null_feature_is_an_error_when_scoring(spark):
    rows = [(i, float(i % 7), float(i % 3), i % 2) for i in range(40)]
    d = spark.createDataFrame(rows, "k int, a double, b double, y int")
    fitted = models.fit(d, "LogisticRegression", ["a", "b"], "y", {"C": 1.0})
    assert models.predict(fitted, d, "y").count() == 40
    holes = d.selectExpr("k", "IF(k % 5 = 0, NULL, a) AS a", "b", "y")
    with pytest.raises(Exception, match="null|Null"):
        models.predict(fitted, holes, "y").collect()
    assert models.predict(models.fit(holes, "LogisticRegression", ["a", "b"], "y", {"C": 1.0}), d, "y").count() == 40


def test_pipeline_scales_by_the_population_deviation(spark):
    d = spark.createDataFrame([(i, float(i * i), i % 2) for i in range(10)], "k int, a double, y int")
    x = models.predict(models.fit(d, "LogisticRegression", ["a"], "y", {"C": 1.0}), d, "y").collect()
    vals = [float(r["scaled"][0]) for r in x]
    assert abs(sum(v * v for v in vals) / len(vals) - 1) < 1e-9


def test_density_of_populations_with_nulls(spark):
    emp = spark.createDataFrame([(i, None if i == 3 else i / 10.0) for i in range(30)], "k int, x double")
    rem = spark.createDataFrame([(None if i == 2 else i / 5.0,) for i in range(30)], "x double")
    v = kernels.observation_bias(emp, rem, "k", ["x"], size=20).first()[0]
    assert v is not None and 0 < v < 1


def test_padding_spans_all_models(spark):
    bench = spark.createDataFrame([("a", 10.0, 11.0, 12.0), ("b", 60.0, 80.0, 90.0)], "model string, min double, mean double, max double")
    means = spark.createDataFrame([("a", "g", 0.11), ("b", "g", 0.5)], "model string, grouping string, value double")
    got = {r["model"]: r for r in reports.benchmark_compare(means, bench).collect()}
    assert got["a"]["pad"] == got["b"]["pad"] == pytest.approx(1.6)
    assert got["a"]["within"] and got["b"]["below_min"]


def test_python_operators_run_where_executors_lack_the_package(tmp_path, sf_small):
    """Another working directory and no PYTHONPATH: only the driver can import
    the package, as on a cluster."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", {os.path.join(repo, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from equigroup.session import get_spark
s = get_spark("local[2]", shuffle_partitions=2); s.sparkContext.setLogLevel("ERROR")
for name in ("i4_gram_spectrum", "g2_greedy_grouping", "g7_bicriterion", "g8_kplus"):
    assert entry.queries()[name](s, {sf_small!r}).count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=600)


def test_no_checkpoint_folder_of_its_own_on_a_cluster():
    from equigroup.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_all_orders_of_few_features_are_taken(spark):
    """A score with interactions against its exact Shapley values."""
    from itertools import permutations

    from equigroup.operators import shapley
    d = spark.createDataFrame([(1, 2.0, 3.0, 5.0)], "k int, a double, b double, c double")
    got = {r["feature"]: r["phi"] for r in shapley.shapley_sampling(
        lambda df: df.selectExpr("*", "a * b * c + a * b AS p1"), d, "k", ["a", "b", "c"], [[1.0, 0.5, 2.0]]).collect()}
    x, base, want = {"a": 2.0, "b": 3.0, "c": 5.0}, {"a": 1.0, "b": 0.5, "c": 2.0}, dict.fromkeys("abc", 0.0)
    for order in permutations("abc"):
        now = dict(base)
        for f in order:
            before = now["a"] * now["b"] * now["c"] + now["a"] * now["b"]
            now[f] = x[f]
            want[f] += (now["a"] * now["b"] * now["c"] + now["a"] * now["b"] - before) / 6
    assert all(abs(got[f] - want[f]) < 1e-9 for f in "abc")


def test_registered_fits_have_no_smaller_sizes(monkeypatch):
    """The queries that stand for an operator run it at its defaults."""
    from equigroup.operators import embed_fit, experiment, flow, shapley
    from equigroup.plans import queries as Q
    seen = []
    monkeypatch.setattr(Q, "_fit_predict", lambda spark, sf, model, params: seen.append(params))
    Q.t2_random_forest(None, ""), Q.t3_boosted_trees(None, ""), Q.t9_predict_proba(None, "")
    assert seen == [{}, {}, {}]
    monkeypatch.setattr(embed_fit, "embed_feature_groups", lambda *a, **k: seen.append((len(a), k)) or {"decoder": 0})
    monkeypatch.setattr(Q.C, "c_emb", lambda *a: None)
    Q.b1_autoencoder_fit(None, "")
    assert seen[3:] == [(3, {})]
    monkeypatch.setattr(Q, "_lr_doc", lambda *a: (None, None, None))
    monkeypatch.setattr(shapley, "kmeans_background", lambda *a: [])
    monkeypatch.setattr(shapley, "shapley_sampling", lambda *a, **k: seen.append(k))
    Q.a2_shapley_sampling(None, "")
    assert seen[4:] == [{}]
