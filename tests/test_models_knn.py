import math

import pytest
from pyspark.sql import functions as F

from equigroup.operators import kernels as K
from equigroup.operators import models as M


def test_candidates_deterministic_and_in_space():
    a = M.draw_candidates("XGBoost", 30, seed=42)
    assert a == M.draw_candidates("XGBoost", 30, seed=42)
    for c in a:
        assert 50 <= c["n_estimators"] <= 500 and 3 <= c["max_depth"] <= 15
        assert 1e-3 <= c["learning_rate"] <= 3e-1 and 0.6 <= c["subsample"] <= 1.0
    rf = M.draw_candidates("RandomForest", 30)
    assert {c["max_features"] for c in rf} <= {"sqrt", "log2", None}
    lr = M.draw_candidates("LogisticRegression", 200)
    logs = [math.log10(c["C"]) for c in lr]
    assert min(logs) >= -2 and max(logs) <= 2 and min(logs) < -1 and max(logs) > 1   # log-uniform spread


def test_knn_matches_brute_force_with_ties(spark):
    train_rows = [(f"t{i:03d}", float(i % 7 if i % 3 else 3), i % 2) for i in range(60)]   # heavy ties at 3.0
    test_rows = [(f"q{i}", float(v), 0) for i, v in enumerate([3.0, 0.0, 6.5, 10.0, 3.4])]
    tr = spark.createDataFrame(train_rows, "k string, x double, y int")
    te = spark.createDataFrame(test_rows, "k string, x double, y int")
    got = {}
    for r in K.knn_1d(tr, te, "k", "x", "y", k=5).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["neighbour"]))
    for _, q, _ in test_rows:
        brute = sorted(train_rows, key=lambda t: (abs(t[1] - q), t[0]))[:5]
        assert [n for _, n in sorted(got[q])] == [t[0] for t in brute]


def test_kde_matches_direct_sum(spark):
    rows = [(i, float(i % 5) / 2, float(i % 3)) for i in range(40)]
    d = spark.createDataFrame(rows, "k int, a double, b double")
    pts = [(0, [0.5, 1.0]), (1, [2.0, 0.0])]
    got = {r["point"]: r["density"] for r in K.kernel_density_at(pts, d, ["a", "b"], 0.5).collect()}
    for pid, (pa, pb) in pts:
        s = sum(math.exp(-((a - pa) ** 2 + (b - pb) ** 2) / (2 * 0.25)) for _, a, b in rows)
        assert got[pid] == pytest.approx(s / (len(rows) * 2 * math.pi * 0.25))


def test_autoencoder_training_reduces_loss(spark):
    import numpy as np
    from equigroup.operators import embed_fit
    rng = np.random.default_rng(1)
    z = rng.normal(size=(300, 1))
    x = np.hstack([z, 2 * z + 0.01 * rng.normal(size=(300, 1)), -z])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    groups = {0: ["a", "b", "c"]}
    short = embed_fit.train_autoencoders(df, groups, {0: 1}, rounds=1)
    long = embed_fit.train_autoencoders(df, groups, {0: 1}, rounds=10)
    assert long["losses"][(0, 1)] < short["losses"][(0, 1)]
