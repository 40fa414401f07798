"""Experiment flows (T10) and repeated cross-validation metrics (V6): each
step is a distributed job (prepare, split, tune, fit, score); the driver only
sequences them and keeps fitted parameters."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equigroup.operators import attribution as A
from equigroup.operators import fairness as FA
from equigroup.operators import metrics as V
from equigroup.operators import models as M
from equigroup.operators import shapley, split
from equigroup.operators.group_embedding import GroupEmbedding
from equigroup.session import gathered, materialize


def fold_metrics(pred: DataFrame, target: str, by: tuple[str, ...]) -> DataFrame:
    rec = V.metric_record(pred, target, "prediction", "p1", "m", by)
    return rec.select(*by, F.col("Accuracy").alias("accuracy"), F.col("F1-score").alias("f1_score"),
                      F.col("Precision").alias("precision"), F.col("ROC AUC").alias("roc_auc"))


def repeated_kfold(df: DataFrame, key: str, model: str, features: list[str], target: str, k: int = 5,
                   repeats: int = 10, seed: int = 42, params: dict | None = None, parallelism: int = 4) -> DataFrame:
    """(repeat, fold, accuracy, f1_score, precision, roc_auc) for a model
    refitted on every (repeat, fold) split of a repeated stratified k-fold.
    The fits run ``parallelism`` at a time; the scored rows of all folds are
    written to the checkpoint folder, and one job counts every fold's metrics."""
    needed = df.select(*dict.fromkeys([key, *features, target]))
    folds = materialize(split.repeated_folds(needed, target, key, k, repeats, seed, "_folds"))
    folds = M.spread(folds, folds.count())
    jobs = [(r, f) for r in range(repeats) for f in range(k)]

    def one(job: tuple[int, int]) -> DataFrame:
        r, f = job
        own = F.col("_folds")[r]
        fitted = M.fit(folds.filter(own != f), model, features, target, params, seed)
        return M.predict(fitted, folds.filter(own == f), target).select(
            F.lit(r).alias("repeat"), F.lit(f).alias("fold"), target, "prediction", "p1")

    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scored = materialize(reduce(DataFrame.union, pool.map(one, jobs)))
    every = df.sparkSession.createDataFrame(jobs, "repeat int, fold int")
    return every.join(fold_metrics(scored, target, ("repeat", "fold")), ["repeat", "fold"], "left")


def tuned_params(train: DataFrame, key: str, model: str, features: list[str], target: str, val_fraction: float,
                 cv_splits: int, n_iter: int, seed: int) -> dict:
    """The parameters chosen on stratified folds of the rows outside a
    stratified validation hold-out; as many fits at a time as the session has cores, 8 at least."""
    tv = split.stratified_holdout(train, target, key, val_fraction, seed)
    sub = split.stratified_kfold(tv.filter(~F.col("is_test")).drop("is_test"), target, key, cv_splits, seed)
    cores = train.sparkSession.sparkContext.defaultParallelism
    return M.tune(sub, model, features, target, "fold", n_iter, seed, parallelism=max(8, cores), refit=False)[1]


def _record(pred: DataFrame, key: str, target: str, name: str, sensitive: Column | None, phi: DataFrame | None,
            protected: str | None) -> DataFrame:
    """Metrics, fairness, the average distance of the instance points, and the
    spread of the attributions (class 1)."""
    rec = V.metric_record(pred, target, "prediction", "p1", name)
    own = None if phi is None else phi.where(F.col("class").isNull() | (F.col("class") == 1))
    if sensitive is not None:
        points = None
        if own is not None and protected is not None:
            points = FA.instance_points(pred, key, "p1", sensitive, own.where(F.col("feature") == protected))
        yt = pred.withColumn("_yt", F.col(target).cast("double"))
        rec = rec.crossJoin(FA.full_record(yt, "_yt", "prediction", sensitive, points))
    if own is not None:
        stats = A.range_stats(A.feature_ranges(own))
        rec = rec.crossJoin(stats.select(*[F.col(c).alias(f"range_{c}") for c in stats.columns]))
    return rec


def run_experiment(train: DataFrame, test: DataFrame, key: str, model: str, features: list[str], target: str,
                   sensitive: Column | None = None, val_fraction: float = 0.15, cv_splits: int = 5,
                   n_iter: int = 30, seed: int = 42, protected: str | None = None, mode: str | None = None) -> DataFrame:
    """Ungrouped flow: stratified validation hold-out, tune on the training
    part (stratified folds), refit on train + validation, score the test rows.
    Both tables go on in as many partitions as their rows fill.
    One row: Model, Accuracy, Precision, F1-score, ROC AUC (+ fairness); with an
    attribution ``mode`` (``each_label``, ``aggregated``) also the spread of the
    attributions and, for the ``protected`` feature, the average distance."""
    train, test = materialize(train), materialize(test)
    few, few_test = (M.spread(d, d.count()) for d in (train, test))
    params = tuned_params(few, key, model, features, target, val_fraction, cv_splits, n_iter, seed)
    fitted = M.fit(few, model, features, target, params, seed)
    pred = materialize(M.predict(fitted, few_test, target))
    phi = None
    if mode is not None:
        phi = shapley.attribute(lambda df: shapley.class_scores(fitted, df), test, key, features,
                                shapley.kmeans_background(train, features, seed=seed), M.class_count(train, target), mode)
        phi = materialize(gathered(phi))
    return _record(pred, key, target, model, sensitive, phi, protected)


def run_grouped_experiment(train: DataFrame, test: DataFrame, key: str, model: str, groups: dict[int, list[str]], target: str,
                           sensitive: Column | None = None, val_fraction: float = 0.15, cv_splits: int = 5, n_iter: int = 30,
                           seed: int = 42, protected: str | None = None, mode: str | None = "each_label",
                           save_to: str | None = None) -> DataFrame:
    """Grouped flow: the groups are embedded (fitted on the training rows), the
    model is tuned and fitted on the latent columns, and both become one
    ``PipelineModel`` (written to ``save_to`` where given) that scores the raw
    test rows. Latent attributions are pushed to the original features. One row
    with the columns of ``run_experiment``."""
    train, test = materialize(train), materialize(test)
    embedding = GroupEmbedding(groups=json.dumps(groups), keyCol=key, seed=seed).fit(train)
    latents = [name for name, _, _ in embedding.latents()]
    inner = materialize(embedding.transform(train))
    params = tuned_params(inner, key, model, latents, target, val_fraction, cv_splits, n_iter, seed)
    fitted = M.fit(inner, model, latents, target, params, seed)
    whole = PipelineModel(stages=[embedding, *fitted.stages])
    if save_to is not None:
        whole.write().overwrite().save(save_to)
    pred = materialize(M.predict(whole, test, target))
    phi = None
    if mode is not None:
        phi = shapley.attribute(lambda df: shapley.class_scores(fitted, df), embedding.transform(test), key, latents,
                                shapley.kmeans_background(inner, latents, seed=seed), M.class_count(train, target),
                                mode, embedding.latents(), embedding.decoder(train.sparkSession))
        phi = materialize(gathered(phi))
    return _record(pred, key, target, model, sensitive, phi, protected)
