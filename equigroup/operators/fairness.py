"""Group fairness (inventory 2.11).

The privileged mask splits rows into two groups (a NULL sensitive value is
unprivileged), so every measure is one grouped aggregate with at most two
output rows, pivoted to one row. Rates use only rows whose truth and
prediction are both 0 or 1; disparate impact and the error spread use all: a
missing prediction is not positive, and a missing truth or prediction is an
error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equigroup.vocab import INSTANCE_ALPHA, RATE_EPS


def group_rates(df: DataFrame, y_true: str, y_pred: str, priv: Column, by: list[str] = ()) -> DataFrame:
    """(by..., privileged, tp, fp, tn, fn, tpr, fpr, precision, error_rate,
    positive_rate, error_std, n) per group (and per segment of ``by``)."""
    by = list(by)
    yt, yp = F.col(y_true), F.col(y_pred)
    binary = yt.isin(0, 1) & yp.isin(0, 1)

    def cnt(cond):
        return F.sum(F.when(binary & cond, 1).otherwise(0)).cast("bigint")

    err = F.when(yt == yp, 0.0).otherwise(1.0)
    g = df.groupBy(*by, priv.alias("privileged")).agg(
        cnt((yt == 1) & (yp == 1)).alias("tp"), cnt((yt == 0) & (yp == 1)).alias("fp"),
        cnt((yt == 0) & (yp == 0)).alias("tn"), cnt((yt == 1) & (yp == 0)).alias("fn"),
        F.avg(F.when(yp == 1, 1.0).otherwise(0.0)).alias("positive_rate"),
        F.stddev_samp(err).alias("error_std"), F.count(F.lit(1)).cast("bigint").alias("n"))
    e = F.lit(RATE_EPS)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return g.select(*by, "privileged", "tp", "fp", "tn", "fn",
                    (tp / (tp + fn + e)).alias("tpr"), (fp / (fp + tn + e)).alias("fpr"),
                    (tp / (tp + fp + e)).alias("precision"),
                    ((fp + fn) / (tp + tn + fp + fn + e)).alias("error_rate"),
                    "positive_rate", "error_std", "n")


def _pair(rates: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row (per segment) with every rate for the privileged (_p) and
    other (_u) group."""
    cols = ["tpr", "fpr", "precision", "error_rate", "positive_rate", "error_std"]
    aggs = []
    for c in cols:
        aggs += [F.max(F.when(F.col("privileged"), F.col(c))).alias(f"{c}_p"),
                 F.max(F.when(~F.col("privileged"), F.col(c))).alias(f"{c}_u")]
    return rates.groupBy(*by).agg(*aggs)


def fairness_record(df: DataFrame, y_true: str, y_pred: str, priv: Column, by: list[str] = ()) -> DataFrame:
    """One row (per segment of ``by``, e.g. per dataset or per source):
    Disparate Impact, Equal Opportunity, Equalized Odds, Predictive Parity,
    N-Sigma (ErrorRate). All segments come out of one grouped aggregate."""
    by = list(by)
    p = _pair(group_rates(df, y_true, y_pred, priv, by), by)
    di = F.when(F.col("positive_rate_p") != 0, F.col("positive_rate_u") / F.col("positive_rate_p"))
    eo = F.abs(F.col("tpr_p") - F.col("tpr_u"))
    eodds = F.greatest(eo, F.abs(F.col("fpr_p") - F.col("fpr_u")))
    pp = F.abs(F.col("precision_p") - F.col("precision_u"))
    pooled = F.sqrt((F.col("error_std_p") ** 2 + F.col("error_std_u") ** 2) / 2)
    ns = F.when(pooled > 0, F.abs(F.col("error_rate_p") - F.col("error_rate_u")) / pooled)
    return p.select(*by, di.alias("Disparate Impact"), eo.alias("Equal Opportunity"),
                    eodds.alias("Equalized Odds"), pp.alias("Predictive Parity"),
                    ns.alias("N-Sigma (ErrorRate)"))


def explanation_bias(attr: DataFrame, rows: DataFrame, key: str, priv: Column) -> DataFrame:
    """(feature, bias): |mean attribution of privileged - of the others| per
    feature. ``attr`` is long (key, feature, phi); ``rows`` carries the mask."""
    m = rows.select(key, priv.alias("_priv"))
    j = attr.join(m, key)
    return j.groupBy("feature").agg(
        F.abs(F.avg(F.when(F.col("_priv"), F.col("phi"))) - F.avg(F.when(~F.col("_priv"), F.col("phi"))))
        .alias("bias"))


def instance_points(df: DataFrame, key: str, p1: str, priv: Column, protected_phi: DataFrame,
                    alpha: float = INSTANCE_ALPHA) -> DataFrame:
    """Instance-level bias points: x = attribution of the protected attribute,
    y = p1 - mean p1 of the row's own group, rows with |y| > alpha only.
    Group means come from a two-row aggregate joined back."""
    g = df.select(key, p1, priv.alias("privileged"))
    mu = g.groupBy("privileged").agg(F.avg(p1).alias("_mu"))
    y = (g.join(F.broadcast(mu), "privileged")
          .select(key, "privileged", (F.col(p1) - F.col("_mu")).alias("y")))
    x = protected_phi.select(key, F.col("phi").alias("x"))
    return y.join(x, key).filter(F.abs(F.col("y")) > F.lit(alpha)).select(key, "privileged", "x", "y")


def instance_bias(points: DataFrame) -> DataFrame:
    """One row: number of points and mean distance from the origin."""
    return points.agg(F.count(F.lit(1)).cast("bigint").alias("n_points"),
                      F.avg(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).alias("Average distance from origin"))


def full_record(df: DataFrame, y_true: str, y_pred: str, priv: Column, points: DataFrame | None = None,
                observation: tuple | None = None, structural: tuple | None = None) -> DataFrame:
    """One row: ``fairness_record`` and, where their inputs are given, the
    instance bias of ``points``, the observation bias of ``observation`` =
    (empirical, removal, key, features) and the structural bias of
    ``structural`` = (empirical, removal, key, feature). Each part is one row."""
    from equigroup.operators import kernels
    out = fairness_record(df, y_true, y_pred, priv)
    if points is not None:
        out = out.crossJoin(instance_bias(points).select("Average distance from origin"))
    if observation is not None:
        out = out.crossJoin(kernels.observation_bias(*observation))
    if structural is not None:
        out = out.crossJoin(kernels.structural_bias(*structural))
    return out


def quadrant_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("privileged", F.signum("x").cast("int").alias("x_sign"),
                          F.signum("y").cast("int").alias("y_sign")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))
