"""Model fitting, tuning and prediction on MLlib (inventory 2.9).

Estimators are ``ml.Pipeline``s: VectorAssembler -> StandardScaler (the
z-score step) -> classifier. Everything is fitted by MLlib's distributed
optimisers; tuning is cross-validation over a deterministic, hash-drawn
candidate list (the same search spaces; the Bayesian surrogate is replaced
by sampling) with the stratified ``fold`` column, in parallel.

Boosted trees see a feature only through its ``BINS`` bins, so rows of the same
bins and label are the same row to them. Where the bins make fewer cells than
there are rows, the rows are counted by cell in one pass and the trees are fitted
on the cells, weighted by their rows (``counted_cells``): the rounds of a fit no
longer read the rows.

RBF-kernel SVM: random Fourier features (Rahimi & Recht, 2007) with
D = ``RFF_DIM`` components approximate the kernel exp(-gamma |x-y|^2), then
LinearSVC (OneVsRest for more classes); probabilities come from a logistic
fit on the margin (Platt scaling).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.functions.columns import is_numeric
from equigroup.operators import logistic
from equigroup.session import gathered, materialize
from equigroup.vocab import MODEL_DEFAULTS, SEARCH_SPACES

RFF_DIM = 64
#: Rows that a partition holds at least, where there are as many, while a model is fitted.
FIT_ROWS = 1 << 16
#: The same for fits that run side by side, for rows of up to ``TUNE_CELLS`` values in all (``FIT_ROWS`` where rows are wider).
TUNE_ROWS, TUNE_CELLS = 1 << 18, 1 << 22
#: Trees are fitted on counted cells of the rows where there are more rows than this, in so many bins a feature
#: (MLlib's own number); cuts of a feature are chosen from the values at so many even ranks. A partition holds so many cells.
CELL_ROWS, BINS, GRID, PART_CELLS = 1 << 16, 32, 1 << 10, 1 << 15
#: Logistic candidates are fitted side by side, a pass for all of them, where there are more rows than this.
SIDE_ROWS = 1 << 16
#: Models that are no more than vectors of weights, so the driver can hold those of all candidates.
WEIGHTS_ONLY = ("LogisticRegression", "MLP", "SVM")
#: Depth of a forest without a depth of its own: the most that Spark allows.
MAX_DEPTH = 30
MODEL_NAMES = list(SEARCH_SPACES)
#: The network is fitted by L-BFGS without a penalty, so it has neither.
NO_COUNTERPART = {"MLP": ("alpha", "learning_rate_init")}


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi);
    a column expression over the feature array (no Python in the row path)."""

    gamma = Param(Params._dummy(), "gamma", "RBF kernel width", typeConverter=TypeConverters.toFloat)
    dim = Param(Params._dummy(), "dim", "number of components", typeConverter=TypeConverters.toInt)
    nInputs = Param(Params._dummy(), "nInputs", "input dimension", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="scaled", outputCol="rff", gamma=1.0, dim=RFF_DIM, nInputs=1, seed=42):
        super().__init__()
        self._setDefault(gamma=1.0, dim=RFF_DIM, nInputs=1, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        g, d, p, s = (self.getOrDefault(x) for x in (self.gamma, self.dim, self.nInputs, self.seed))
        rng = np.random.default_rng(s)
        w = rng.normal(0.0, math.sqrt(2.0 * g), size=(d, p))
        b = rng.uniform(0.0, 2.0 * math.pi, size=d)
        x = df.withColumn("_rff_in", vector_to_array(self.getInputCol()))
        comps = []
        for j in range(d):
            dot = " + ".join(f"{float(w[j, i])!r}D * _rff_in[{i}]" for i in range(p))
            comps.append(f"{math.sqrt(2.0 / d)!r}D * cos({dot} + {float(b[j])!r}D)")
        out = x.withColumn("_rff_arr", F.expr(f"array({', '.join(comps)})"))
        return out.withColumn(self.getOutputCol(), array_to_vector("_rff_arr")).drop("_rff_arr", "_rff_in")


def _place(x: str, cuts: list[float], at: int = 0) -> str:
    """SQL for the number of ascending ``cuts`` below ``x``, found by halving."""
    if not cuts:
        return f"{float(at)!r}D"
    i = len(cuts) // 2
    return f"IF({x} <= DOUBLE('{cuts[i]!r}'), {_place(x, cuts[:i], at)}, {_place(x, cuts[i + 1:], at + i + 1)})"


class Binned(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The bin of each component: 0 up to its first cut, 1 above that and up to
    the second, and so on; a column expression over the feature array."""

    cuts = Param(Params._dummy(), "cuts", "ascending cuts of each component", typeConverter=TypeConverters.toList)

    @keyword_only
    def __init__(self, inputCol="scaled", outputCol="binned", cuts=None):
        super().__init__()
        self._setDefault(inputCol="scaled", outputCol="binned", cuts=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        places = [_place(f"_bin_in[{j}]", cuts) for j, cuts in enumerate(self.getOrDefault(self.cuts))]
        out = df.withColumn("_bin_in", vector_to_array(self.getInputCol())).withColumn("_bin_arr", F.expr(f"array({', '.join(places)})"))
        return out.withColumn(self.getOutputCol(), array_to_vector("_bin_arr")).drop("_bin_arr", "_bin_in")


def draw_candidates(model: str, n: int = 30, seed: int = 42) -> list[dict]:
    """n parameter sets drawn deterministically from the model's search space
    (u = md5(i|param|seed) / 2^128 mapped through the prior). Parameters that
    the estimator has no counterpart for (``NO_COUNTERPART``) are not drawn."""
    import hashlib
    out = []
    for i in range(n):
        cand = {}
        for name, spec in SEARCH_SPACES[model].items():
            if name in NO_COUNTERPART.get(model, ()):
                continue
            h = int(hashlib.md5(f"{i}|{name}|{seed}".encode()).hexdigest(), 16) / float(1 << 128)
            kind = spec[0]
            if kind == "log-uniform":
                lo, hi = math.log(spec[1]), math.log(spec[2])
                cand[name] = math.exp(lo + h * (hi - lo))
            elif kind == "uniform":
                cand[name] = spec[1] + h * (spec[2] - spec[1])
            elif kind == "integer":
                cand[name] = int(spec[1] + math.floor(h * (spec[2] - spec[1] + 1)))
            else:
                choices = spec[1]
                cand[name] = choices[min(int(h * len(choices)), len(choices) - 1)]
        out.append(cand)
    return out


def _classifier(model: str, params: dict, n_features: int, n_classes: int, n_rows: int, seed: int, cells: bool = False):
    """The stages after scaling; with ``cells`` those of boosted trees on counted cells."""
    p = {**MODEL_DEFAULTS.get(model, {}), **params}
    if model == "LogisticRegression":
        reg = 1.0 / (float(p["C"]) * max(n_rows, 1))
        return [LogisticRegression(featuresCol="scaled", labelCol="label", regParam=reg, maxIter=2000)]
    if model == "RandomForest":
        mf = p.get("max_features", "sqrt")
        return [RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=int(p["n_estimators"]),
                                       maxDepth=int(p.get("max_depth") or MAX_DEPTH),
                                       featureSubsetStrategy="all" if mf is None else mf, seed=seed)]
    if model == "XGBoost":
        column, weight = ("binned", {"weightCol": "weight"}) if cells else ("scaled", {})
        gbt = GBTClassifier(featuresCol=column, labelCol="label", **weight, maxIter=int(p["n_estimators"]),
                            maxDepth=int(p["max_depth"]), stepSize=float(p["learning_rate"]),
                            subsamplingRate=float(p.get("subsample", 1.0)),
                            featureSubsetStrategy=str(round(float(p.get("colsample_bytree", 1.0)), 4)), seed=seed)
        if n_classes > 2:
            return [OneVsRest(classifier=gbt, featuresCol=column, labelCol="label", **weight, parallelism=n_classes)]
        return [gbt]
    if model == "MLP":
        h = int(p["hidden_layer_sizes"])
        return [MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label",
                                               layers=[n_features, h, max(n_classes, 2)], maxIter=1000, seed=seed)]
    if model == "SVM":
        gamma = p.get("gamma", "scale")
        if gamma == "scale":
            gamma = 1.0 / max(n_features, 1)   # features are standardised (variance 1)
        reg = 1.0 / (float(p["C"]) * max(n_rows, 1))
        rff = RandomFourierFeatures(inputCol="scaled", outputCol="rff", gamma=float(gamma), nInputs=n_features,
                                    seed=seed)
        svc = LinearSVC(featuresCol="rff", labelCol="label", regParam=reg, maxIter=100)
        if n_classes > 2:
            svm = OneVsRest(classifier=svc, featuresCol="rff", labelCol="label",
                            rawPredictionCol="svm_raw", predictionCol="svm_pred", parallelism=n_classes)
        else:
            svm = svc.setRawPredictionCol("svm_raw").setPredictionCol("svm_pred")
        platt = LogisticRegression(featuresCol="svm_raw", labelCol="label", maxIter=100)
        return [rff, svm, platt]
    raise ValueError(f"unknown model {model}")


def _scaling(features: list[str], n_rows: int) -> list:
    """The stages before the classifier, the same for every set of parameters."""
    return [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"),
            StandardScaler(inputCol="features", outputCol="sample_scaled", withMean=True, withStd=True),
            # from the sample to the population standard deviation of ``n_rows`` rows
            ElementwiseProduct(scalingVec=Vectors.dense([math.sqrt(n_rows / max(n_rows - 1, 1))] * len(features)),
                               inputCol="sample_scaled", outputCol="scaled")]


def build_pipeline(model: str, features: list[str], params: dict, n_classes: int, n_rows: int,
                   seed: int = 42) -> Pipeline:
    return Pipeline(stages=_scaling(features, n_rows) + _classifier(model, params, len(features), n_classes, n_rows, seed))


def _label(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("label", F.col(target).cast("double"))


def class_count(df: DataFrame, target: str) -> int:
    """Number of classes = max label + 1 (labels are 0..k-1 codes)."""
    return int(df.agg(F.max(target)).first()[0]) + 1


def spread(df: DataFrame, n_rows: int, rows: int | None = None) -> DataFrame:
    """``df`` in as many partitions of ``rows`` (``FIT_ROWS``) as its rows fill: an
    optimiser runs a job a step, so a small table left in a partition per shuffle
    bucket costs its scheduling hundreds of times over."""
    return df.coalesce(max(1, -(-n_rows // (rows or FIT_ROWS))))


def _cuts(values: list[float]) -> list[float]:
    """The greatest values of ``BINS`` bins of as even a size as equal values
    allow, without the last; fewer different values than that are a bin each.
    A value that fills a bin or more has one of its own."""
    xs, counts = np.unique(np.asarray(values, dtype=float), return_counts=True)
    if len(xs) <= BINS:
        return xs[:-1].tolist()
    left, bins, held, out = int(counts.sum()), BINS, 0, []
    for i in range(len(xs) - 1):
        held += int(counts[i])
        # closed where it is full, or would be fuller with the next value than it now lacks
        if bins > 1 and (held * bins >= left or 2 * held * bins + int(counts[i + 1]) * bins > 2 * left and counts[i + 1] * bins > left):
            out.append(float(xs[i]))
            left, bins, held = left - held, bins - 1, 0
    return out


def feature_cuts(d: DataFrame, features: list[str]) -> list[list[float]]:
    """The cuts of each feature, from all rows: between all its values where they
    are ``BINS`` or fewer, else at even ranks (found to 1 / 4096 of the rows)."""
    x = {f: F.col(f"`{f}`").cast("double") for f in features}
    ranks = [i / GRID for i in range(GRID + 1)]
    row = gathered(d).agg(*[a for j, f in enumerate(features) for a in (  # one task puts the parts together
        F.percentile_approx(x[f], ranks, 4 * GRID).alias(f"g{j}"), F.approx_count_distinct(x[f]).alias(f"d{j}"), F.max(x[f]).alias(f"m{j}"))]).first()
    few = [j for j in range(len(features)) if row[f"d{j}"] <= 2 * BINS]
    # a set holds about 2 * BINS values at most
    sets = gathered(d).agg(*[F.collect_set(x[features[j]]).alias(f"s{j}") for j in few]).first() if few else {}
    values = [sets[f"s{j}"] if j in few and len(sets[f"s{j}"]) <= BINS else row[f"g{j}"] for j in range(len(features))]
    return [[c for c in _cuts(v) if c < row[f"m{j}"]] for j, v in enumerate(values)]


def counted_cells(d: DataFrame, features: list[str], n_rows: int, n_classes: int, scaler: PipelineModel):
    """The rows of ``d`` counted by cell (the bins of all features, and the
    label): (cells with ``binned``, ``label`` and ``weight``, the ``Binned`` stage
    that finds a scaled row's bins). A cut lies halfway between the scaled rows
    beside it. None where the bins allow more cells than there are rows."""
    cuts = feature_cuts(d, features)
    if math.prod(len(c) + 1 for c in cuts) * n_classes > n_rows:
        return None
    xs = [f"CAST(`{f}` AS DOUBLE)" for f in features]
    bins = [f"_b{j}" for j in range(len(xs))]
    rows = d.selectExpr("label", *[f"{x} AS _x{j}" for j, x in enumerate(xs)], *[f"{_place(x, c)} AS {b}" for x, c, b in zip(xs, cuts, bins)])
    cells = rows.groupBy(*bins, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"), *[
        e for j in range(len(xs)) for e in (F.min(f"_x{j}").alias(f"_lo{j}"), F.max(f"_x{j}").alias(f"_hi{j}"))])
    cells = materialize(gathered(cells))
    ends = []  # of each feature: the least and greatest value of each bin, BINS rows at most
    for j, b in enumerate(bins):
        found = cells.groupBy(b).agg(F.min(f"_lo{j}").alias("lo"), F.max(f"_hi{j}").alias("hi")).collect()
        ends.append([(r["lo"], r["hi"]) for r in sorted(found, key=lambda r: r[b])])
    most = max(map(len, ends))
    table = d.sparkSession.createDataFrame([(i, side, *[e[min(i, len(e) - 1)][side] for e in ends]) for i in range(most) for side in (0, 1)],
                                           ", ".join(["_bin int", "_side int", *[f"`{f}` double" for f in features]]))
    scaled = {(r["_bin"], r["_side"]): r["scaled"].toArray() for r in scaler.transform(table).select("_bin", "_side", "scaled").collect()}
    halfway = [[float((scaled[i, 1][j] + scaled[i + 1, 0][j]) / 2) for i in range(len(e) - 1)] for j, e in enumerate(ends)]
    cells = spread(cells, cells.count(), PART_CELLS).sortWithinPartitions(*bins, "label")  # sums in the same order in each run
    return cells.select(array_to_vector(F.array(*bins)).alias("binned"), "label", "weight"), Binned(cuts=halfway)


def fit(df: DataFrame, model: str, features: list[str], target: str, params: dict | None = None,
        seed: int = 42) -> PipelineModel:
    """The model fitted on the rows that have all values. Boosted trees of whole
    rows are fitted on counted cells where there are more than ``CELL_ROWS`` rows
    and fewer cells."""
    d = _label(df, target).na.drop(subset=[*features, "label"])  # a row without a value teaches nothing
    d = d.select(*dict.fromkeys([*features, "label"])).persist()
    try:
        n, top = d.agg(F.count(F.lit(1)), F.max("label")).first()
        k, few, params = int(top) + 1, spread(d, n), params or {}
        if model == "XGBoost" and n > CELL_ROWS and float(params.get("subsample", 1.0)) == 1.0 and all(is_numeric(d.schema[f].dataType) for f in features):
            scaler = Pipeline(stages=_scaling(features, n)).fit(few)
            found = counted_cells(d, features, n, k, scaler)
            if found:
                cells, binned = found
                trees = Pipeline(stages=_classifier(model, params, len(features), k, n, seed, cells=True)).fit(cells)
                return PipelineModel(stages=[*scaler.stages, binned, *trees.stages])
        return build_pipeline(model, features, params, k, n, seed).fit(few)
    finally:
        d.unpersist()


def _transformed(fitted: PipelineModel, d: DataFrame) -> DataFrame:
    """``fitted.transform(d)``. Where the model sees bins, and these make no more
    than ``CELL_ROWS`` cells, every cell is scored once and the rows look theirs up."""
    at = next((i for i, stage in enumerate(fitted.stages) if isinstance(stage, Binned)), None)
    sizes = [] if at is None else [len(c) + 1 for c in fitted.stages[at].getOrDefault("cuts")]
    if at is None or math.prod(sizes) > CELL_ROWS:
        return fitted.transform(d)
    steps = [math.prod(sizes[:j]) for j in range(len(sizes))]
    column = fitted.stages[at].getOutputCol()
    every = d.sparkSession.range(math.prod(sizes)).select(F.col("id").alias("_cell"), array_to_vector(F.array(*[
        F.expr(f"CAST(id DIV {step} % {size} AS DOUBLE)") for step, size in zip(steps, sizes)])).alias(column))
    scored = PipelineModel(stages=fitted.stages[at + 1:]).transform(every).drop(column)
    rows = PipelineModel(stages=fitted.stages[:at + 1]).transform(d).withColumn("_bin_in", vector_to_array(column))
    rows = rows.withColumn("_cell", F.expr(" + ".join(f"CAST(_bin_in[{j}] AS BIGINT) * {step}" for j, step in enumerate(steps)))).drop("_bin_in")
    return rows.join(F.broadcast(scored), "_cell", "left").drop("_cell")


def predict(fitted: PipelineModel, df: DataFrame, target: str | None = None) -> DataFrame:
    """Adds ``prediction`` and ``p1`` (class-1 probability; from the class
    margins when the model gives no probability). One row per input row; a
    null feature is an error (impute it first)."""
    d = _label(df, target) if target else df
    out = _transformed(fitted, d)
    if "probability" in out.columns:
        return out.withColumn("p1", vector_to_array("probability")[1])
    raw = vector_to_array("rawPrediction")
    soft = F.transform(raw, lambda r: F.exp(r))
    return out.withColumn("p1", soft[1] / F.aggregate(soft, F.lit(0.0), lambda a, b: a + b))


def accuracies(models: list[PipelineModel], held: DataFrame) -> list[float]:
    """Accuracy of each model on the rows of ``held``, all in one job."""
    hits = [m.transform(held).select(F.lit(i).alias("model"), (F.col("prediction") == F.col("label")).cast("double").alias("hit"))
            for i, m in enumerate(models)]
    shares = reduce(DataFrame.union, hits).groupBy("model").agg(F.avg("hit").alias("share")).collect()  # a row a model
    return [share for _, share in sorted((r["model"], r["share"]) for r in shares)]


def _one_by_one(d: DataFrame, model: str, features: list[str], fold_col: str, cands: list[dict], n_folds: int, n: int,
                k: int, seed: int, parallelism: int) -> list[float]:
    """The accuracy of each (candidate, fold) on the rows of the fold, a fit each."""
    def scaled(f: int) -> tuple[DataFrame, DataFrame]:
        train = d.where(F.col(fold_col) != f)
        scaler = Pipeline(stages=_scaling(features, n)).fit(train)
        return tuple(scaler.transform(part).select("scaled", "label").persist() for part in (train, d.where(F.col(fold_col) == f)))

    def fitted(job: tuple[int, int]) -> PipelineModel:
        i, f = job
        return Pipeline(stages=_classifier(model, cands[i], len(features), k, n, seed)).fit(folds[f][0])

    jobs = [(i, f) for i in range(len(cands)) for f in range(n_folds)]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        folds = list(pool.map(scaled, range(n_folds)))
        if model in WEIGHTS_ONLY:
            found = list(pool.map(fitted, jobs))
            per_fold = list(pool.map(lambda f: accuracies(found[f::n_folds], folds[f][1]), range(n_folds)))
            each = [per_fold[f][i] for i, f in jobs]
        else:
            each = list(pool.map(lambda job: accuracies([fitted(job)], folds[job[1]][1])[0], jobs))
    for parts in folds:
        for part in parts:
            part.unpersist()
    return each


def tune(df: DataFrame, model: str, features: list[str], target: str, fold_col: str = "fold",
         n_iter: int = 30, seed: int = 42, parallelism: int = 4, refit: bool = True):
    """Pick the candidate with the best mean accuracy over the folds in
    ``fold_col`` and refit it on all rows. Returns (model, params, cv table);
    without ``refit`` the model is None.

    The rows are written to the checkpoint folder once and scaled once a fold,
    since candidates differ in the classifier alone; candidates may change its
    shape (RFF width, network layers), so each (candidate, fold) is a fit of its
    own, ``parallelism`` at a time. Models of weights alone are scored by one
    job a fold, trees one by one, as only so many fit on the driver. Logistic
    models of more than ``SIDE_ROWS`` rows are fitted and scored side by side,
    in passes over the rows that do all of them (``logistic``)."""
    d = _label(df, target).withColumn(fold_col, F.col(fold_col).cast("int"))
    d = materialize(gathered(d.select(*dict.fromkeys([*features, "label", fold_col]))))
    sizes = {r[fold_col]: (r["n"], r["top"]) for r in  # a row per fold
             d.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("top")).collect()}
    if any(f is None or f < 0 for f in sizes):
        raise ValueError("a fold is a number from 0")
    n_folds, n = max(sizes) + 1, sum(size for size, _ in sizes.values())
    if len(sizes) < max(n_folds, 2):
        raise ValueError("every fold needs rows, and rows outside it")
    k = int(max(top for _, top in sizes.values() if top is not None)) + 1
    cands = draw_candidates(model, n_iter, seed)
    d = spread(d, n, min(TUNE_ROWS, max(FIT_ROWS, TUNE_CELLS // max(1, len(features)))))

    each = None
    if model == "LogisticRegression" and n > SIDE_ROWS and all(is_numeric(d.schema[f].dataType) for f in features):
        penalties = [1.0 / (float(c["C"]) * n) for c in cands]
        d = d.persist()
        found = logistic.side_by_side(d, features, fold_col, penalties, n_folds, k)
        each = None if found is None else found[0].ravel().tolist()
    if each is None:
        each = _one_by_one(d, model, features, fold_col, cands, n_folds, n, k, seed, parallelism)
    scores = [(i, float(np.mean(each[i * n_folds:(i + 1) * n_folds]))) for i in range(len(cands))]
    best_i = max(scores, key=lambda t: (t[1], -t[0]))[0]
    best = build_pipeline(model, features, cands[best_i], k, n, seed).fit(d) if refit else None
    d.unpersist()
    spark = df.sparkSession
    table = spark.createDataFrame([(i, s, str(cands[i])) for i, s in scores],
                                  "candidate int, mean_accuracy double, params string")
    return best, cands[best_i], table
