"""Population-comparison kernels (F9, F10, J6, J7).

Observation bias: Gaussian kernel densities of two populations at a fixed
number of sampled points. The sample (300 points by default) is bounded by
its parameter, so it travels to every task as a constant; each task adds its
rows' kernel values per point with numpy and emits one partial per point,
and one grouped sum finishes. No cross join, no data through the driver.

Structural bias: AUC of a k-nearest-neighbour classifier telling the two
populations apart, on one feature. In one dimension the k nearest training
points of a query lie within k sorted positions on either side, so each query
needs at most 3k candidates, looked up by rank with an equi-join on unique
positions (no cross join, and no hot key whatever the value distribution).
Ties in distance are broken by the training key. On several features the
neighbours come from ``neighbours.knn``; there are at most a few more scores
than k, since a score is a share of k neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equigroup.functions.hashing import hash_below
from equigroup.functions.ordering import range_bucket, ranked, running_total
from equigroup.operators.metrics import roc_auc
from equigroup.operators.neighbours import knn
from equigroup.operators.split import bootstrap_draw
from equigroup.vocab import KDE_BANDWIDTH, KDE_SAMPLE_POINTS, KNN_NEIGHBOURS, KNN_TEST_FRACTION


def kernel_density_at(points: list[tuple[int, list[float]]], population: DataFrame, features: list[str],
                      bandwidth: float = KDE_BANDWIDTH) -> DataFrame:
    """(point, density): Gaussian KDE of ``population`` at each given point."""
    ids = np.array([p[0] for p in points], dtype=np.int64)
    pts = np.array([p[1] for p in points], dtype=float).reshape(len(points), len(features))
    h2 = bandwidth * bandwidth
    schema = T.StructType([T.StructField("point", T.LongType()), T.StructField("ksum", T.DoubleType()),
                           T.StructField("n", T.LongType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(len(ids))
        n = 0
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            if not len(x):
                continue
            d2 = ((x[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2)   # rows x points
            acc += np.exp(-d2 / (2.0 * h2)).sum(axis=0)
            n += len(x)
        yield pd.DataFrame({"point": ids, "ksum": acc, "n": np.full(len(ids), n, dtype=np.int64)})

    sums = (population.select(*features).na.drop().mapInPandas(partial, schema)
                      .groupBy("point").agg(F.sum("ksum").alias("ksum"), F.sum("n").alias("n")))
    norm = math.pow(2.0 * math.pi * h2, len(features) / 2.0)
    return sums.select("point", (F.col("ksum") / (F.col("n") * F.lit(norm))).alias("density"))


def sample_points(population: DataFrame, key: str, features: list[str], size: int = KDE_SAMPLE_POINTS,
                  seed: int = 42) -> list[tuple[int, list[float]]]:
    """``size`` points drawn with replacement (bounded by ``size``) from the
    rows whose features are all there, as in the density passes."""
    rows = bootstrap_draw(population.na.drop(subset=features), key, size, seed).select("draw", *features).collect()
    return [(int(r["draw"]), [float(r[f]) for f in features]) for r in rows]


def observation_bias(empirical: DataFrame, removal: DataFrame, key: str, features: list[str],
                     size: int = KDE_SAMPLE_POINTS, bandwidth: float = KDE_BANDWIDTH, seed: int = 42) -> DataFrame:
    """One row: 0.5 * mean over sampled points of |density_emp - density_rem|.
    Both populations are read three times (sampling, two density passes), so
    their feature columns are checkpointed once (reliably)."""
    from equigroup.session import materialize
    empirical = materialize(empirical.select(key, *features))
    removal = materialize(removal.select(*features))
    pts = sample_points(empirical, key, features, size, seed)
    d1 = kernel_density_at(pts, empirical, features, bandwidth).withColumnRenamed("density", "d_emp")
    d2 = kernel_density_at(pts, removal, features, bandwidth).withColumnRenamed("density", "d_rem")
    draws = empirical.sparkSession.createDataFrame([(p[0],) for p in pts], "point long")
    j = draws.join(d1, "point", "left").join(d2, "point", "left")
    return j.agg((F.lit(0.5) * F.avg(F.abs(F.coalesce("d_emp", F.lit(0.0)) - F.coalesce("d_rem", F.lit(0.0)))))
                 .alias("Observation Bias (TV)"))


def knn_1d(train: DataFrame, test: DataFrame, key: str, x: str, label: str,
           k: int = KNN_NEIGHBOURS) -> DataFrame:
    """Neighbours of every distinct test value q on feature ``x``:
    (q, rank, neighbour, distance, neighbour_label), the k nearest training
    rows with distance ties broken by the training key.

    Neighbours depend on q only, so the work is per distinct value:
    * the k smallest keys per distinct training value (``row_number <= k``
      becomes a partial top-k before the shuffle, so a hot value ships k rows
      per task);
    * distinct training values get exact ranks (no ties by construction);
    * each distinct q gets c = number of distinct training values below it
      (running count over the union of the two value sets);
    * candidates are the 2k+1 distinct values at ranks c-k .. c+k, each with
      its k best rows: at most (2k+1)k rows per q, from which the top k are
      kept."""
    tr = train.select(F.col(key).alias("tkey"), F.col(x).cast("double").alias("v"), F.col(label).alias("lab"))
    topv = (tr.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("tkey")))
              .filter(F.col("_r") <= k).drop("_r"))
    vals = tr.select("v").distinct()
    qs = test.select(F.col(x).cast("double").alias("q")).distinct()
    u = vals.select(F.col("v").alias("s"), F.lit(1).alias("t")).unionByName(
        qs.select(F.col("q").alias("s"), F.lit(0).alias("t")))
    u = range_bucket(u, "s", "_qb")
    qpos = (running_total(u, [], ["s", "t"], "t", "_qb", out="c_lt")
            .filter(F.col("t") == 0).select(F.col("s").alias("q"), "c_lt"))
    vpos = ranked(range_bucket(vals, "v", "_qb"), [], ["v"], "_qb", out="pos").drop("_qb")
    cand = (qpos.select("q", F.explode(F.sequence(F.col("c_lt") - k, F.col("c_lt") + k)).alias("pos"))
                .join(vpos, "pos").join(topv, "v")
                .select("q", "tkey", "lab", F.abs(F.col("v") - F.col("q")).alias("distance")))
    w = Window.partitionBy("q").orderBy("distance", "tkey")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select("q", "rank", F.col("tkey").alias("neighbour"), "distance",
                        F.col("lab").alias("neighbour_label")))


def two_populations(empirical: DataFrame, removal: DataFrame, key: str, features: list[str],
                    test_fraction: float = KNN_TEST_FRACTION, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and hash-drawn hold-out rows of both: features, origin (0 =
    empirical, 1 = removal) and the key _k."""
    both = (empirical.select(key, *features).withColumn("origin", F.lit(0))
            .unionByName(removal.select(key, *features).withColumn("origin", F.lit(1))))
    both = both.withColumn("_k", F.concat(F.col("origin").cast("string"), F.lit(":"), F.col(key).cast("string")))
    held_out = hash_below("_k", test_fraction, seed)
    return both.filter(~held_out), both.filter(held_out)


def structural_bias_on(empirical: DataFrame, removal: DataFrame, key: str, features: list[str],
                       k: int = KNN_NEIGHBOURS, test_fraction: float = KNN_TEST_FRACTION, seed: int = 42) -> DataFrame:
    """As ``structural_bias``, with neighbours on several features. Hold-out
    rows without all of them are left out. Equal hold-out rows are counted
    before they meet their score, so no point is a hot key."""
    train, test = two_populations(empirical, removal, key, features, test_fraction, seed)
    point = F.array(*[F.col(f).cast("double") + F.lit(0.0) for f in features])
    proba = knn(train, test, "_k", features, "origin", k).groupBy("q").agg(F.avg(F.col("neighbour_label").cast("double")).alias("p1"))
    counts = test.groupBy(point.alias("q"), "origin").agg(F.count(F.lit(1)).alias("n"))
    scored = counts.join(proba, "q").select("origin", "p1", "n").groupBy("p1").pivot("origin", [0, 1]).agg(F.sum("n")).na.fill(0, ["0", "1"])
    # a score's rows of the removal population beat the lower ones of the other, half of the equal ones
    below = scored.select("p1", F.col("0").alias("n0"), F.col("1").alias("n1"),
                          F.coalesce(F.sum("0").over(Window.orderBy("p1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("under"))
    sums = below.agg(F.sum(F.col("n1") * (F.col("under") + F.col("n0") / 2)).alias("won"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return sums.select(F.when((F.col("n0") > 0) & (F.col("n1") > 0), F.col("won") / (F.col("n0") * F.col("n1")))
                       .alias("Structural Bias (kNN AUC)"))


def structural_bias(empirical: DataFrame, removal: DataFrame, key: str, x: str,
                    k: int = KNN_NEIGHBOURS, test_fraction: float = KNN_TEST_FRACTION, seed: int = 42) -> DataFrame:
    """One row: AUC of a k-NN classifier separating the two populations
    (label 0 = empirical, 1 = removal), hash-drawn hold-out of ``test_fraction``."""
    both = (empirical.select(key, x).withColumn("origin", F.lit(0))
            .unionByName(removal.select(key, x).withColumn("origin", F.lit(1))))
    both = both.withColumn("_k", F.concat(F.col("origin").cast("string"), F.lit(":"), F.col(key).cast("string")))
    both = both.withColumn("_test", hash_below("_k", test_fraction, seed))
    train = both.filter(~F.col("_test"))
    test = both.filter(F.col("_test"))
    nn = knn_1d(train, test, "_k", x, "origin", k)
    proba = nn.groupBy("q").agg(F.avg(F.col("neighbour_label").cast("double")).alias("p1"))
    scored = test.select("origin", F.col(x).cast("double").alias("q")).join(proba, "q")
    return roc_auc(scored, "origin", "p1").select(F.col("roc_auc").alias("Structural Bias (kNN AUC)"))
