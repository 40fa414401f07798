"""Group autoencoders: local epochs with averaging against a long full-batch run."""

import numpy as np
import pytest

from equigroup.operators import embed_fit as E


def table(spark, x, parts):
    names = [f"f{j}" for j in range(x.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(parts), names


def low_rank(n, p, rank, noise, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, rank)) @ rng.normal(size=(rank, p)) + noise * rng.normal(size=(n, p))


def long_run(x, d, seed=42, steps=4000, alpha=1e-4):
    """Full-batch Adam from the same start."""
    p = x.shape[1]
    w = E._flat(E._init(p, d, np.random.default_rng(seed)))
    m = v = np.zeros_like(w)
    for t in range(1, steps + 1):
        loss, g = E._grad_sums(x, E._unflat(w, p, d))
        w, m, v = E._adam(w, m, v, t, E._flat(g) / x.size + alpha * w, 1e-2)
    return loss / x.size


@pytest.mark.parametrize("parts, d", [(1, 2), (4, 3)])
def test_as_good_as_a_long_run(spark, parts, d):
    x = low_rank(900, 6, 4, 0.3, parts)
    x = (x - x.mean(0)) / x.std(0)
    df, names = table(spark, x, parts)
    got = E.train_autoencoders(df, {7: names}, {7: d})
    assert got["losses"][(7, d)] <= 1.05 * long_run(x, d)
    w1, b1, w2, b2 = got["models"][(7, d)]
    direct = (((np.maximum(x @ w1 + b1, 0) @ w2 + b2) - x) ** 2).mean()
    assert direct == pytest.approx(got["losses"][(7, d)])  # the loss told is that of the weights returned
    assert got["rounds"][(7, d)] < 100


def test_widths_are_tried_in_order_and_stop(spark):
    """A group that two numbers describe stops early; noise goes on to the last width."""
    rng = np.random.default_rng(4)
    t = rng.normal(size=(600, 1))
    x = np.hstack([t, -2 * t, 0.5 * t, rng.normal(size=(600, 4))])
    df, names = table(spark, x, 2)
    groups = {0: names[:3], 1: names[3:]}
    scaled, _ = E.scaled_features(df, "id", groups)
    tried = E.choose_widths(scaled, "id", groups, max_dim=3)
    assert [(g, d) for g, d, _, _ in tried if g == 1] == [(1, 1), (1, 2), (1, 3)]
    own = [t for t in tried if t[0] == 0]
    assert own[-1][3] and own[-1][2] <= 1e-2 and len(own) <= 2 and all(not t[3] and t[2] > 1e-2 for t in own[:-1])
    assert [t[3] for t in tried if t[0] == 1] == [False, False, True]


def test_holdout_errors_in_one_scan_are_exact(spark):
    x = low_rank(200, 5, 2, 0.5, 9)
    df, names = table(spark, x, 3)
    groups = {0: names[:2], 3: names[2:]}
    rng = np.random.default_rng(0)
    models = {(0, 1): E._init(2, 1, rng), (3, 2): E._init(3, 2, rng), (3, 1): E._init(3, 1, rng)}
    got = {(r["group_id"], r["dim"]): r["mse"] for r in E.holdout_mse(df, groups, models, "id % 4 = 0").collect()}
    held = x[::4]
    for (g, d), (w1, b1, w2, b2) in models.items():
        z = held[:, :2] if g == 0 else held[:, 2:]
        assert got[(g, d)] == pytest.approx((((np.maximum(z @ w1 + b1, 0) @ w2 + b2) - z) ** 2).mean())


def test_fitted_tables_and_odd_rows(spark):
    """Rows with a null are left out; a table without rows keeps its start."""
    x = low_rank(120, 4, 1, 0.1, 3)
    df, names = table(spark, x, 2)
    nulls = df.selectExpr("id", "IF(id % 10 = 0, NULL, f0) AS f0", "f1", "f2", "f3")
    res = E.embed_feature_groups(nulls, "id", {0: names[:2], 1: names[2:]}, max_dim=2, rounds=6)
    assert res["choice"].where("chosen").count() == 2 and {r["group_id"] for r in res["decoder"].collect()} == {0, 1}
    empty = E.train_autoencoders(df.where("id < 0"), {0: names}, {0: 1})
    assert np.isinf(empty["losses"][(0, 1)]) and empty["models"][(0, 1)][0].shape == (4, 1)
