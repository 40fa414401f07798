"""Classification metrics (inventory 2.10) as aggregations.

Everything goes through a confusion table ``groupBy(y, yhat).count()`` (map-side
combined, classes^2 rows) or, for AUC, a score-count table; no per-row work
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equigroup.functions.ordering import range_bucket, running_total


def _beside(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Two tables of one row per ``by`` (none: of one row) as one."""
    return a.join(b, list(by), "left") if by else a.crossJoin(b)


def confusion(df: DataFrame, y_true: str, y_pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by truth and prediction; rows without either are left out."""
    df = df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
    return df.groupBy(*by, F.col(y_true).alias("y"), F.col(y_pred).alias("yhat")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(label, tp, fp, fn) for every label seen in truth or prediction."""
    contrib = conf.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"),
                 F.when(F.col("y") != F.col("yhat"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.when(F.col("y") != F.col("yhat"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("long").alias("fn")))).alias("c")).select(*by, "c.*")
    return contrib.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0 (the undefined-metric rule)."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def macro_scores(df: DataFrame, y_true: str, y_pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per ``by``): macro precision, recall and F1 (plain mean over labels)."""
    pc = per_class(confusion(df, y_true, y_pred, by), by).groupBy(*by)
    return pc.agg(F.avg(_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("macro_precision"),
                  F.avg(_ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("macro_recall"),
                  F.avg(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"))


def accuracy(df: DataFrame, y_true: str, y_pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"))


def roc_auc(df: DataFrame, y_true: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per ``by``, few): exact ROC AUC of ``score`` for the greater of exactly two truth
    labels (mid-ranks for ties); NULL unless the truth has two labels.
    Scores are first counted per distinct value (ties collapse there), then a
    bucketed running count gives each value the number of lower scores. Rows
    without a truth label or without a score are left out of all counts."""
    df = df.where(F.col(y_true).isNotNull() & F.col(score).isNotNull())
    labels = df.groupBy(*by).agg(F.count_distinct(y_true).alias("_k"), F.max(y_true).alias("_pos"))
    t = (_beside(df, F.broadcast(labels), by)
           .groupBy(*by, F.col(score).cast("double").alias("s"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(y_true) == F.col("_pos")).cast("long")).alias("np")))
    t = range_bucket(t, "s", "_qb")
    r = running_total(t, list(by), ["s"], "n", "_qb", out="below")
    mid = F.col("below") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    agg = r.groupBy(*by).agg(F.sum(F.col("np") * mid).alias("_sr"), F.sum("np").alias("_p"),
                F.sum(F.col("n") - F.col("np")).alias("_q"))
    auc = (F.col("_sr") - F.col("_p") * (F.col("_p") + 1) / F.lit(2.0)) / (F.col("_p") * F.col("_q"))
    return _beside(agg, labels, by).select(*by, F.when(F.col("_k") == 2, auc).alias("roc_auc"))


def metric_record(df: DataFrame, y_true: str, y_pred: str, score: str | None, model: str,
                  by: tuple[str, ...] = ()) -> DataFrame:
    """One row (Model, Accuracy, Precision, F1-score, ROC AUC), or one per ``by``, a few folds or runs."""
    acc = accuracy(df, y_true, y_pred, by)
    mac = macro_scores(df, y_true, y_pred, by)
    if score:
        both = _beside(_beside(acc, mac, by), roc_auc(df, y_true, score, by), by)
    else:
        both = _beside(acc, mac, by).withColumn("roc_auc", F.lit(None).cast("double"))
    return (both
               .select(*by, F.lit(model).alias("Model"), F.col("accuracy").alias("Accuracy"),
                       F.col("macro_precision").alias("Precision"), F.col("macro_f1").alias("F1-score"),
                       F.col("roc_auc").alias("ROC AUC")))


def recall_from(precision: Column, f1: Column) -> Column:
    """Recall back-computed from macro precision and F1: f1*p/(2p-f1), NULL when
    p <= 0, f1 <= 0 or the denominator <= 0."""
    den = 2 * precision - f1
    return F.when((precision > 0) & (f1 > 0) & (den > 0), f1 * precision / den)


def run_summary(runs: DataFrame, config_cols: list[str], metrics: list[str]) -> DataFrame:
    """Per configuration: mean, sample std and number of runs per metric."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("num_runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}")]
    return runs.groupBy(*config_cols).agg(*aggs)
