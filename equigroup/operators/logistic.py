"""Logistic models of many penalties and folds, fitted side by side (T1, T8).

Tuning needs a model for every penalty and every fold left out. Fitted one by
one, each of them reads the rows some ten times. Here a pass works out what all
models want of a row, so the number of passes does not grow with the models:

1. one model of all rows is found by Newton steps; a pass gives its gradient and
   Hessian by fold, so what a fold's absence changes is a subtraction;
2. each model starts a Newton step from there, with its own fold and penalty;
3. a pass gives the gradients of all models (and their hits on the fold left
   out) at their own weights, and those not yet at the optimum step on.

The models are those of MLlib's ``LogisticRegression``: softmax over the classes
(the logit of class 1 for two), the mean loss plus ``penalty`` / 2 times the
squared weights of the features in units of their sample deviation in the rows
fitted, free intercepts, no weight for a feature that is constant there. A model
is done when its loss is within ``NEAR`` (of the first model's) of the least.

What a task sends to the driver is bounded by ``MOST`` numbers over all tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.session import gathered

NEAR, START_NEAR = 1e-10, 1e-7
#: Passes for the first model and for all models, before the work is given up.
PASSES, ALL_PASSES = 40, 12
#: Numbers that all tasks of a pass send at most, and numbers a task works on at once.
MOST, AT_ONCE = 1 << 23, 1 << 17


def _sums(d: DataFrame, work) -> np.ndarray:
    """The sum of what ``work(fold, label, x)`` gives for the batches of rows."""
    import pyarrow as pa

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                fold, label, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                part = work(fold, label, np.column_stack(x))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = gathered(d).mapInArrow(run, "sums binary").collect()  # a row a task
    return np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0)


def _by_fold(fold, label, x, centre, scale, n_folds, n_classes, at_once):
    """(fold, codes of the classes, standardised features and a 1) of pieces of the rows of a fold."""
    if np.isnan(x).any() or np.isnan(label).any():
        raise ValueError("a row without a value: impute it first")
    y = label.astype(int)
    if (y != label).any() or (y < 0).any() or (y >= n_classes).any():
        raise ValueError(f"a label is a number from 0 to {n_classes - 1}")
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    for f in range(n_folds):
        rows = np.flatnonzero(fold == f)
        for i in range(0, len(rows), at_once):
            part = rows[i:i + at_once]
            yield f, y[part], z[part]


def _odds(z, w):
    """Odds of the classes 1, 2, ... against class 0, for weights (classes, features, models)."""
    return [np.exp(np.minimum(z @ (w[c] - w[0]), 700.0)) for c in range(1, len(w))]


def _curved(w, n_folds, n_classes, centre, scale):
    """Work of a pass for one model: by fold, its loss, gradient and Hessian."""
    p1 = w.shape[1]
    q = p1 * n_classes

    def work(fold, label, x):
        out = np.zeros((n_folds, 1 + q + q * q))
        for f, y, z in _by_fold(fold, label, x, centre, scale, n_folds, n_classes, max(1, AT_ONCE // p1)):
            margins = z @ w.T
            margins -= margins.max(axis=1, keepdims=True)
            p = np.exp(margins)
            total = p.sum(axis=1, keepdims=True)
            p /= total
            own = np.zeros_like(p)
            own[np.arange(len(y)), y] = 1.0
            out[f, 0] += (np.log(total[:, 0]) - margins[np.arange(len(y)), y]).sum()
            out[f, 1:1 + q] += ((p - own).T @ z).ravel()
            h = np.empty((n_classes, p1, n_classes, p1))
            for a in range(n_classes):
                for b in range(a, n_classes):
                    block = z.T @ (z * (p[:, a] * ((a == b) - p[:, b]))[:, None])
                    h[a, :, b], h[b, :, a] = block, block  # a block is symmetric
            out[f, 1 + q:] += h.ravel()
        return out.ravel()

    return work


def _gradients(w, at, n_folds, n_classes, centre, scale):
    """Work of a pass for the models of weights ``w`` (classes, features, models)
    that leave out the folds ``at``: their gradients but for class 0 (what the
    others leave) and hits on their folds."""
    _, p1, m = w.shape
    others, owns = ([np.flatnonzero(side(at, f)) for f in range(n_folds)] for side in (np.not_equal, np.equal))
    train, held = ([w[:, :, models] for models in some] for some in (others, owns))

    def work(fold, label, x):
        grad, hits = np.zeros((n_classes - 1, p1, m)), np.zeros(m)
        for f, y, z in _by_fold(fold, label, x, centre, scale, n_folds, n_classes, max(1, AT_ONCE // m)):
            if len(others[f]):
                odds = _odds(z, train[f])
                whole = 1.0 + sum(odds)
                for c, odd in enumerate(odds, 1):
                    share = odd / whole
                    share[y == c] -= 1.0
                    grad[c - 1][:, others[f]] += z.T @ share
            if len(owns[f]):
                best, found = np.ones((len(y), len(owns[f]))), np.zeros((len(y), len(owns[f])), dtype=int)
                for c, odd in enumerate(_odds(z, held[f]), 1):
                    found[odd > best] = c
                    best = np.maximum(best, odd)
                hits[owns[f]] += (found == y[:, None]).sum(axis=0)
        return np.concatenate([grad.ravel(), hits])

    return work


class _Problem:
    """Steps of a model in the numbers that are free: the weights of all classes,
    or those of class 1 where there are two."""

    def __init__(self, n_features: int, n_classes: int):
        self.first, self.n_classes, self.p1 = int(n_classes == 2), n_classes, n_features + 1

    def step(self, w, grad, hess, spread, live, penalty):
        """(Newton step, the loss it is expected to save): ``grad`` and ``hess`` of
        the mean loss over classes and features; ``spread`` are the variances that
        the penalty counts in, ``live`` the features that vary."""
        k, own = self.n_classes - self.first, slice(self.first, None)
        cost = penalty * np.append(spread, 0.0)
        g = (grad[own] + cost * w[own]).ravel()
        h = hess.reshape(self.n_classes, self.p1, self.n_classes, self.p1)[own, :, own].reshape(k * self.p1, k * self.p1)
        h = h + np.diag(np.tile(cost, k))
        if k > 1:  # the same added to all intercepts changes nothing: that way the step is 0
            level = np.tile(np.append(np.zeros(self.p1 - 1), 1.0), k)
            h = h + np.outer(level, level)
        fixed = np.tile(np.append(~live, False), k)
        g[fixed], h[fixed, :], h[:, fixed] = 0.0, 0.0, 0.0
        h[fixed, fixed] = 1.0
        found = np.linalg.solve(h, g)
        out = np.zeros_like(w)
        out[own] = -found.reshape(k, self.p1)
        return out, float(g @ found) / 2

    def penalised(self, w, spread, penalty):
        return penalty / 2 * float((w[self.first:, :-1] ** 2 @ spread).sum())


def _moments(d: DataFrame, features: list[str], fold_col: str, label: str, n_folds: int, n_classes: int):
    """Rows, means and sums of squared deviations of the features by fold, and rows by (fold, class)."""
    aggs = [a for j, f in enumerate(features) for a in (F.avg(f"`{f}`").alias(f"m{j}"), F.var_pop(f"`{f}`").alias(f"v{j}"))]
    rows, mean, dev = np.zeros(n_folds), np.zeros((n_folds, len(features))), np.zeros((n_folds, len(features)))
    for r in d.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n"), *aggs).collect():  # a row a fold
        f, n = r[fold_col], r["n"]
        rows[f], mean[f], dev[f] = n, [r[f"m{j}"] for j in range(len(features))], [n * r[f"v{j}"] for j in range(len(features))]
    classes = np.zeros((n_folds, n_classes))
    for r in d.groupBy(fold_col, label).agg(F.count(F.lit(1)).alias("n")).limit(n_folds * n_classes + 1).collect():
        if r[label] is None or not 0 <= r[label] < n_classes or r[label] != int(r[label]):
            raise ValueError(f"a label is a number from 0 to {n_classes - 1}")
        classes[r[fold_col], int(r[label])] = r["n"]
    return rows, mean, dev, classes


def _varies(n, mean, dev):
    """Whether a feature varies by more than rounding."""
    return dev > n * (1e-13 * np.abs(mean)) ** 2


def _together(rows, mean, dev):
    """Rows, mean and sum of squared deviations of several parts."""
    n = rows.sum()
    centre = (rows[:, None] * mean).sum(axis=0) / n
    return n, centre, (dev + rows[:, None] * (mean - centre) ** 2).sum(axis=0)


def side_by_side(d: DataFrame, features: list[str], fold_col: str, penalties: list[float], n_folds: int, n_classes: int):
    """(accuracy of each penalty and fold on the rows of that fold, weights of
    the model: (penalty, fold, class, feature or intercept)) for models fitted on
    the rows of the other folds. ``d`` has ``label`` and folds from 0; it is read
    several times, so persist it. None where this does not fit (many weights, a
    class missing beside a fold, classes that can be told apart without error)."""
    p, models = len(features), len(penalties) * n_folds
    q = (p + 1) * n_classes
    tasks = max(16, 2 * d.sparkSession.sparkContext.defaultParallelism)
    if n_classes < 2 or max(n_folds * (1 + q + q * q), models * (2 + q)) * tasks > MOST:
        return None
    rows, mean, dev, classes = _moments(d, features, fold_col, "label", n_folds, n_classes)
    n, centre, whole_dev = _together(rows, mean, dev)
    if not (np.isfinite(whole_dev).all() and ((classes.sum(axis=0) - classes) > 0).all()):
        return None
    varies = _varies(n, centre, whole_dev)
    scale = np.sqrt(np.where(varies, whole_dev, n) / n)
    d = d.select(F.col(fold_col), F.col("label").cast("double"), *[F.col(f"`{f}`").cast("double") for f in features])
    left_n, left_mean, spread, live = np.zeros(n_folds), np.zeros((n_folds, p)), np.zeros((n_folds, p)), np.zeros((n_folds, p), dtype=bool)
    for f in range(n_folds):  # the rows beside the fold
        rest = np.arange(n_folds) != f
        left_n[f], left_mean[f], left_dev = _together(rows[rest], mean[rest], dev[rest])
        live[f], spread[f] = varies & _varies(left_n[f], left_mean[f], left_dev), left_dev / max(left_n[f] - 1, 1) / scale ** 2
    problem, all_spread = _Problem(p, n_classes), whole_dev / max(n - 1, 1) / scale ** 2

    # 1. one model of all rows
    middle = float(np.median(penalties))
    w = np.zeros((n_classes, p + 1))
    w[:, -1] = np.log(classes.sum(axis=0))
    w[:, -1] -= w[0, -1] if n_classes == 2 else w[:, -1].mean()
    step, least = np.zeros_like(w), np.inf
    for _ in range(PASSES):
        by_fold = _sums(d, _curved(w, n_folds, n_classes, centre, scale)).reshape(n_folds, -1)
        loss = by_fold[:, 0].sum() / n + problem.penalised(w, all_spread, middle)
        if not np.isfinite(loss):
            return None
        if loss > least * (1 + 1e-9):  # too far
            step = step / 2
            w = w - step
            continue
        grads, hess = by_fold[:, 1:1 + q].reshape(n_folds, n_classes, p + 1), by_fold[:, 1 + q:]
        try:
            step, saves = problem.step(w, grads.sum(axis=0) / n, hess.sum(axis=0) / n, all_spread, varies, middle)
        except np.linalg.LinAlgError:
            return None
        least = loss
        if saves <= START_NEAR * loss:
            break
        w = w + step
    else:
        return None

    # 2. and 3. all models, fold by fold in each penalty
    beside = {f: (grads.sum(axis=0) - grads[f], (hess.sum(axis=0) - hess[f]) / left_n[f]) for f in range(n_folds)}
    jobs = [(lam, f) for lam in penalties for f in range(n_folds)]
    start = []  # what a feature that is constant beside the fold adds goes to the intercept
    for f in range(n_folds):
        own = np.where(np.append(live[f], True), w, 0.0)
        own[:, -1] += (w[:, :-1] - own[:, :-1]) @ ((left_mean[f] - centre) / scale)
        start.append(own)
    try:
        ws = [start[f] + problem.step(start[f], beside[f][0] / left_n[f], beside[f][1], spread[f], live[f], lam)[0] for lam, f in jobs]
        accuracy, going, before = np.full(models, np.nan), list(range(models)), np.full(models, np.inf)
        for _ in range(ALL_PASSES):
            at = np.array([jobs[i][1] for i in going])
            m = len(going)
            stacked = np.stack([ws[i] for i in going], axis=-1)
            sums = _sums(d, _gradients(stacked, at, n_folds, n_classes, centre, scale))
            others, hits = sums[:-m].reshape(n_classes - 1, p + 1, m), sums[-m:]
            again = []
            for j, i in enumerate(going):
                lam, f = jobs[i]
                grad = np.concatenate([-others[..., j].sum(axis=0, keepdims=True), others[..., j]]) / left_n[f]
                step, saves = problem.step(ws[i], grad, beside[f][1], spread[f], live[f], lam)
                if not saves < before[i]:  # the Hessian of the first model does not serve this one
                    return None
                before[i] = saves
                if saves <= NEAR * least:
                    accuracy[i] = hits[j] / rows[f]
                else:
                    ws[i] = ws[i] + step
                    again.append(i)
            going = again
            if not going:
                break
        else:
            return None
    except np.linalg.LinAlgError:
        return None
    weights = np.stack(ws).reshape(len(penalties), n_folds, n_classes, p + 1)
    weights[..., :-1] /= scale
    weights[..., -1] -= weights[..., :-1] @ centre
    return accuracy.reshape(len(penalties), n_folds), weights
