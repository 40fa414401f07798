"""Model-agnostic Shapley values by permutation sampling (A2) with a k-means
background (A3), and the attribution dispatch (A7).

For every explained row, permutation and background point, the p+1 prefix
rows (features in the permutation prefix taken from the row, the others from
the background point) are generated by ``explode`` and scored by ONE
``model.transform``; consecutive differences (a window over p+1 rows) are the
marginal contributions, averaged per (row, feature). The permutations and the
background are bounded by their parameters and travel as literals.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.functions.columns import quote
from equigroup.operators import attribution as A


def kmeans_background(df: DataFrame, features: list[str], k: int = 50, seed: int = 42) -> list[list[float]]:
    """Up to k cluster centres of the (training) rows; weights are dropped."""
    asm = VectorAssembler(inputCols=features, outputCol="_bgx", handleInvalid="error")
    x = asm.transform(df.na.drop(subset=features))
    n = x.count()
    model = KMeans(featuresCol="_bgx", k=max(1, min(k, n)), seed=seed).fit(x)
    return [[float(v) for v in c] for c in model.clusterCenters()]


def shapley_by_class(model, rows: DataFrame, key: str, features: list[str], background: list[list[float]],
                     n_classes: int, n_permutations: int = 8, seed: int = 42, output: str = "scores") -> DataFrame:
    """(key, class, feature, phi): sampled Shapley values of every class at once.
    ``model`` is a callable DataFrame -> DataFrame that adds ``output``, an array
    of ``n_classes`` doubles (a probability vector, margins); each masked row is
    scored once, whatever the classes. Where the features have no more than
    ``n_permutations`` orders, all of them are taken and the values are exact."""
    p = len(features)
    rng = np.random.default_rng(seed)
    if math.factorial(p) <= n_permutations:
        perms = [list(o) for o in permutations(range(p))]
    else:
        perms = [rng.permutation(p).tolist() for _ in range(n_permutations)]
    # rank[perm][feature] = position of the feature in the permutation
    ranks = [[perm.index(f) for f in range(p)] for perm in perms]
    combos = [(pi, bi) for pi in range(len(perms)) for bi in range(len(background))]
    combo_arr = "array(" + ", ".join(
        f"named_struct('_perm', {pi}, '_bg', {bi}, '_rk', array({', '.join(map(str, ranks[pi]))}), "
        f"'_bv', array({', '.join(repr(float(v)) + 'D' for v in background[bi])}))" for pi, bi in combos) + ")"
    x = rows.selectExpr(quote(key), *[quote(f) for f in features], f"inline({combo_arr})")
    x = x.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(p))))
    masked = x.selectExpr(quote(key), "_perm", "_bg", "_j", "_rk", *[
        f"case when _rk[{i}] < _j then cast({quote(f)} as double) else _bv[{i}] end as {quote(f)}"
        for i, f in enumerate(features)])
    scored = model(masked).select(key, "_perm", "_bg", "_j", "_rk", output)
    # differences along a permutation telescope: the score of prefix j counts for
    # the feature just added (rank j - 1) and against the one added next (rank j)
    signs = F.array(F.struct((F.col("_j") - 1).alias("rank"), F.lit(1.0).alias("sign")),
                    F.struct(F.col("_j").alias("rank"), F.lit(-1.0).alias("sign")))
    part = scored.withColumn("_s", F.explode(signs)).filter((F.col("_s.rank") >= 0) & (F.col("_s.rank") < p))
    names = F.array(*[F.lit(f) for f in features])
    moved = part.select(key, F.element_at(names, F.array_position("_rk", F.col("_s.rank")).cast("int")).alias("feature"),
                        F.col("_s.sign").alias("_sign"), F.col(output).alias("_o"))
    share = F.array(*[F.sum(F.col("_sign") * F.get("_o", F.lit(c))) / F.lit(float(len(combos))) for c in range(n_classes)])
    return (moved.groupBy(key, "feature").agg(share.alias("_phi"))
            .select(key, F.posexplode("_phi").alias("class", "phi"), "feature").select(key, "class", "feature", "phi"))


def shapley_sampling(model, rows: DataFrame, key: str, features: list[str], background: list[list[float]],
                     n_permutations: int = 8, seed: int = 42, output: str = "p1") -> DataFrame:
    """(key, feature, phi): ``shapley_by_class`` of one score column, e.g. the
    class-1 probability that a fitted pipeline's predict adds."""
    one = shapley_by_class(lambda df: model(df).withColumn("_score", F.array(F.col(output))), rows, key, features, background,
                           1, n_permutations, seed, "_score")
    return one.drop("class")


def class_scores(fitted, df: DataFrame, output: str = "scores") -> DataFrame:
    """``output``: a fitted pipeline's probability vector as an array (its class
    margins where the model gives no probability)."""
    scored = fitted.transform(df)
    return scored.withColumn(output, vector_to_array("probability" if "probability" in scored.columns else "rawPrediction"))


def attribute(model, rows: DataFrame, key: str, features: list[str], background: list[list[float]], n_classes: int,
              mode: str = "each_label", latents: list[tuple[str, int, int]] | None = None, decoder: DataFrame | None = None,
              class_weights: dict | None = None, **sampling) -> DataFrame:
    """A7: (key, class, feature, phi) of raw features, or, with ``latents`` (name,
    group, dim of each feature scored) and ``decoder``, of the original features
    behind latent ones. ``each_label`` keeps the classes; ``aggregated``
    collapses them first (weighted sum, else sum of absolute values) under a
    null class, before latent values are pushed to the features."""
    if mode not in ("each_label", "aggregated"):
        raise ValueError(f"unknown mode {mode!r}")
    phi = shapley_by_class(model, rows, key, features, background, n_classes, **sampling)
    if mode == "aggregated":
        phi = A.collapse_classes(phi, key, class_weights).withColumn("class", F.lit(None).cast("int"))
    if latents is not None:
        table = rows.sparkSession.createDataFrame(latents, "feature string, group_id int, dim int")
        phi = A.decompose(phi.join(F.broadcast(table), "feature").drop("feature"), decoder, key)
    return phi.select(key, "class", "feature", "phi")
