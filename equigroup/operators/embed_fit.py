"""Training the group autoencoders (B1, B2): local epochs and averaging.

A round is one Spark job. Every partition starts from the current weights of
all models still in training (one per group), runs ``local_steps`` Adam steps
on mini-batches of its rows, and returns its weights and moments times its row
count; their sums (map-side combined, one row a parameter) give the average
the next round starts from. Before training, the rows' loss under the incoming
weights is added up, so the driver knows the exact loss of every average. A
model whose loss no longer falls goes back to its best weights and halves its
step; after ``PLATEAUS`` halvings it is done and drops out of the jobs.

A task holds one Arrow batch of rows; the driver holds the weights (features x
width per group). No row is collected or shuffled.

Model (per group g, width d): h = relu(z W1 + b1), z_hat = h W2 + b2, loss =
mean squared reconstruction error over rows and features (+ L2 alpha).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.functions.hashing import hash_below

#: Halvings of the step after which a model is done.
PLATEAUS = 3


def _init(p: int, d: int, rng: np.random.Generator) -> list[np.ndarray]:
    lim1, lim2 = np.sqrt(6.0 / (p + d)), np.sqrt(6.0 / (d + p))
    return [rng.uniform(-lim1, lim1, (p, d)), np.zeros(d), rng.uniform(-lim2, lim2, (d, p)), np.zeros(p)]


def _flat(ws):
    return np.concatenate([w.ravel() for w in ws])


def _unflat(v, p, d):
    a = p * d
    return [v[:a].reshape(p, d), v[a:a + d], v[a + d:a + d + d * p].reshape(d, p), v[a + d + d * p:]]


def _grad_sums(z: np.ndarray, ws: list[np.ndarray]):
    w1, b1, w2, b2 = ws
    pre = z @ w1 + b1
    h = np.maximum(pre, 0.0)
    out = h @ w2 + b2
    err = out - z                                   # n x p
    loss = float((err ** 2).sum())
    g_out = 2.0 * err
    gw2 = h.T @ g_out
    gb2 = g_out.sum(axis=0)
    g_h = (g_out @ w2.T) * (pre > 0)
    gw1 = z.T @ g_h
    gb1 = g_h.sum(axis=0)
    return loss, [gw1, gb1, gw2, gb2]


def _adam(theta, m, v, t, grad, lr):
    m = 0.9 * m + 0.1 * grad
    v = 0.999 * v + 0.001 * grad * grad
    step = lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta - step, m, v


def _local_training(x: np.ndarray, state: dict, shape: dict, steps: int, batch: int, alpha: float, seed: int) -> None:
    """``steps`` mini-batch Adam steps of each model on the rows ``x``, in place.
    ``state``: key -> [theta, m, v, t, lr]; ``shape``: key -> (columns, width)."""
    rng = np.random.default_rng(seed)
    for key, s in state.items():
        z = x[:, shape[key][0]]
        p, d = z.shape[1], shape[key][1]
        order = np.empty(0, int)
        for _ in range(steps):
            if not len(order):
                order = rng.permutation(len(z))
            part, order = z[order[:batch]], order[batch:]
            _, grads = _grad_sums(part, _unflat(s[0], p, d))
            s[3] += 1
            s[0], s[1], s[2] = _adam(s[0], s[1], s[2], s[3], _flat(grads) / (len(part) * p) + alpha * s[0], s[4])


def train_autoencoders(scaled: DataFrame, groups: dict[int, list[str]], dims: dict[int, int], rounds: int = 100,
                       local_steps: int = 64, batch: int = 200, lr: float = 1e-2, alpha: float = 1e-4,
                       tolerance: float = 1e-3, seed: int = 42, row_filter=None) -> dict:
    """Train one autoencoder per group at the width ``dims`` gives it.
    ``scaled`` holds z-scored feature columns; rows with a null are left out.
    Returns {"models": {(g, d): [W1, b1, W2, b2]}, "losses", "rounds": rounds
    each model took}; a group without any row keeps its starting weights."""
    feats = sorted({f for g in dims for f in groups[g]})
    data = (scaled if row_filter is None else scaled.filter(row_filter)).select(*feats).na.drop().persist()
    rng = np.random.default_rng(seed)
    shape = {g: ([feats.index(f) for f in groups[g]], dims[g]) for g in sorted(dims)}
    start = {g: _flat(_init(len(groups[g]), dims[g], rng)) for g in shape}
    state = {g: [w, np.zeros_like(w), np.zeros_like(w), 0, lr] for g, w in start.items()}
    best = {g: (np.inf, *state[g][:3]) for g in shape}
    plateaus, took = dict.fromkeys(shape, 0), dict.fromkeys(shape, 0)
    live = list(shape)
    schema = "model int, idx int, value double"  # idx -2 = rows, -1 = loss, then theta, m, v
    for turn in range(rounds):
        if not live:
            break
        sent = {g: list(state[g]) for g in live}

        def partial(batches: Iterator[pd.DataFrame], sent=sent, turn=turn) -> Iterator[pd.DataFrame]:
            n, loss = 0, dict.fromkeys(sent, 0.0)
            total = {g: 0.0 for g in sent}
            for i, pdf in enumerate(batches):
                x = pdf.to_numpy(dtype=float)
                if not len(x):
                    continue
                own = {g: list(s) for g, s in sent.items()}
                for g in sent:
                    z = x[:, shape[g][0]]
                    w1, b1, w2, b2 = _unflat(sent[g][0], z.shape[1], shape[g][1])
                    loss[g] += float((((np.maximum(z @ w1 + b1, 0.0) @ w2 + b2) - z) ** 2).sum())
                _local_training(x, own, shape, local_steps, batch, alpha, seed + 1000 * turn + i)
                n += len(x)
                for g, s in own.items():
                    total[g] = total[g] + len(x) * np.concatenate(s[:3])
            for g in sent if n else ():
                yield pd.DataFrame({"model": np.int32(g), "idx": np.arange(-2, len(total[g]), dtype=np.int32),
                                    "value": np.concatenate([[float(n), loss[g]], total[g]])})

        sums: dict[int, dict[int, float]] = {}
        for r in data.mapInPandas(partial, schema).groupBy("model", "idx").agg(F.sum("value").alias("v")).collect():
            sums.setdefault(r["model"], {})[r["idx"]] = r["v"]
        if not sums:
            break
        for g in list(live):
            n, k = sums[g][-2], len(state[g][0])
            loss = sums[g][-1] / (n * len(groups[g]))  # of the weights this round began with
            took[g] = turn + 1
            if loss < best[g][0] * (1 - tolerance):
                best[g] = (loss, *state[g][:3])
                mean = np.array([sums[g][j] for j in range(3 * k)]) / n
                state[g][:3] = mean[:k], mean[k:2 * k], mean[2 * k:]
                state[g][3] += local_steps
                continue
            if loss < best[g][0]:
                best[g] = (loss, *state[g][:3])
            plateaus[g] += 1
            state[g] = [*best[g][1:], state[g][3], state[g][4] / 2]
            if plateaus[g] >= PLATEAUS:
                live.remove(g)
    data.unpersist()
    final = {g: best[g][1] if np.isfinite(best[g][0]) else state[g][0] for g in shape}
    return {"models": {(g, dims[g]): _unflat(final[g], len(groups[g]), dims[g]) for g in shape},
            "losses": {(g, dims[g]): best[g][0] for g in shape}, "rounds": {(g, dims[g]): took[g] for g in shape}}


def holdout_mse(scaled: DataFrame, groups: dict[int, list[str]], models: dict, row_filter) -> DataFrame:
    """(group_id, dim, mse) on the rows selected by ``row_filter``: all models in
    one scan, each task adding up squared errors."""
    feats = sorted({f for g, _ in models for f in groups[g]})
    cols = {g: [feats.index(f) for f in groups[g]] for g, _ in models}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, dict.fromkeys(models, 0.0)
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            n += len(x)
            for (g, d), (w1, b1, w2, b2) in models.items():
                z = x[:, cols[g]]
                total[(g, d)] += float((((np.maximum(z @ w1 + b1, 0.0) @ w2 + b2) - z) ** 2).sum())
        yield pd.DataFrame([(g, d, t, n * len(cols[g])) for (g, d), t in total.items()], columns=["group_id", "dim", "e", "n"])

    return (scaled.filter(row_filter).select(*feats).na.drop().mapInPandas(partial, "group_id int, dim int, e double, n long")
            .groupBy("group_id", "dim").agg(F.try_divide(F.sum("e"), F.sum("n")).alias("mse")))


def weight_tables(spark, groups: dict[int, list[str]], models: dict) -> dict:
    """Fitted weights in the table shapes the apply side consumes."""
    enc, eb, dec, db = [], [], [], []
    feats = set()
    for (g, d), (w1, b1, w2, b2) in models.items():
        for i, f in enumerate(groups[g]):
            feats.add(f)
            for j in range(d):
                enc.append((g, f, j, float(w1[i, j])))
                dec.append((g, j, f, float(w2[j, i])))
            db.append((g, f, float(b2[i])))
        for j in range(d):
            eb.append((g, j, float(b1[j])))
    return {
        "encoder": spark.createDataFrame(enc, "group_id int, feature string, dim int, w double"),
        "enc_bias": spark.createDataFrame(eb, "group_id int, dim int, b double"),
        "decoder": spark.createDataFrame(dec, "group_id int, dim int, feature string, w double"),
        "dec_bias": spark.createDataFrame(db, "group_id int, feature string, b double"),
        "moments_identity": spark.createDataFrame([(f, 0.0, 1.0) for f in sorted(feats)],
                                                  "feature string, mean double, scale double"),
    }


def scaled_features(df: DataFrame, key: str, groups: dict[int, list[str]]) -> tuple[DataFrame, DataFrame]:
    """The key and z-scored feature columns, and the one-row moments."""
    from equigroup.operators.prep import apply_zscore, fit_moments
    feats = sorted({f for fs in groups.values() for f in fs})
    moments = fit_moments(df, feats)
    return apply_zscore(df.select(key, *feats), feats, moments), moments


def choose_widths(scaled: DataFrame, key: str, groups: dict[int, list[str]], loss_threshold: float = 1e-2,
                  max_dim: int = 5, seed: int = 42, **training) -> list[tuple]:
    """B2: (group, width, hold-out MSE, chosen) of the widths tried. Widths are
    tried in order, all open groups at once, on a hash-drawn 80 % split; a group
    is closed by the first width whose MSE on the other 20 % is within
    ``loss_threshold``, else by ``max_dim``."""
    test = hash_below(key, 0.2, f"width{seed}")  # not the draw that other splits make with this seed
    tried: list[tuple] = []
    open_groups = sorted(groups)
    for d in range(1, max_dim + 1):
        if not open_groups:
            break
        fitted = train_autoencoders(scaled, groups, dict.fromkeys(open_groups, d), seed=seed, row_filter=~test, **training)
        for r in holdout_mse(scaled, groups, fitted["models"], test).orderBy("group_id").collect():
            done = d == max_dim or (r["mse"] is not None and r["mse"] <= loss_threshold)
            tried.append((r["group_id"], d, r["mse"], done))
            if done:
                open_groups.remove(r["group_id"])
    return sorted(tried)


CHOICE = "group_id int, dim int, holdout_mse double, chosen boolean"


def fit_groups(df: DataFrame, key: str, groups: dict[int, list[str]], loss_threshold: float = 1e-2, max_dim: int = 5,
               seed: int = 42, **training) -> tuple[dict, list[tuple], list[tuple]]:
    """B1 + B2: z-score, choose each group's width, refit the chosen widths on
    all rows: (models by (group, width), (feature, mean, scale) rows, widths tried)."""
    scaled, moments = scaled_features(df, key, groups)
    scaled = scaled.persist()
    tried = choose_widths(scaled, key, groups, loss_threshold, max_dim, seed, **training)
    chosen = {g: d for g, d, _, done in tried if done}
    final = train_autoencoders(scaled, groups, chosen, seed=seed, **training)
    scaled.unpersist()
    one = moments.first()
    mom = [(f, float(one[f"{f}__mean"]), float(one[f"{f}__scale"])) for f in sorted({f for fs in groups.values() for f in fs})]
    return final["models"], mom, tried


def embed_feature_groups(df: DataFrame, key: str, groups: dict[int, list[str]], loss_threshold: float = 1e-2,
                         max_dim: int = 5, seed: int = 42, **training) -> dict:
    """``fit_groups`` as the weight tables, the moments and the choice table."""
    models, mom, tried = fit_groups(df, key, groups, loss_threshold, max_dim, seed, **training)
    spark = df.sparkSession
    return {**weight_tables(spark, groups, models),
            "moments": spark.createDataFrame(mom, "feature string, mean double, scale double"),
            "choice": spark.createDataFrame(tried, CHOICE)}
