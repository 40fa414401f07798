"""Exact k nearest neighbours on several features (J7, F10).

The training points are dealt to cells, each point to the nearest of a number
of pivots (training points drawn by hash, ``PIVOTS`` at most). A query first
looks into its own cell; its k-th distance there bounds how far its neighbours
can be, and only the cells which that bound reaches are looked into in a second
round: a cell is out of reach if its pivot is farther than the bound and the
cell's radius together, or if the plane halfway between the two pivots is
farther than the bound.

Neighbours depend on the features only, so equal queries are looked up once,
and of equal training points the k with the smallest keys stand for all. A cell
with many points or queries is worked on in blocks of ``BLOCK`` of each; every
block gives the k best of its points, so no pair of rows is ever written out.
What is broadcast is one row per pivot. Rows without all features are left out;
distance ties go by the training key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equigroup.session import materialize

PIVOTS = 1024
BLOCK = 4096
#: Share by which bounds are widened, for the rounding of distances.
SLACK = 1e-9


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to those of y, features added in order."""
    total = np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        total += (x[:, f, None] - y[None, :, f]) ** 2
    return np.sqrt(total)


def _points(column, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), width)


def _complete(df: DataFrame, features: list[str], *more) -> DataFrame:
    """The features as array x of doubles, for rows that have them all (NaN counts as missing)."""
    cols = [F.col(f).cast("double") for f in features]
    whole = F.lit(True)
    for c in cols:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    return df.where(whole).select(F.array(*[c + F.lit(0.0) for c in cols]).alias("x"), *more)


def _nearest_pivot(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``df`` plus cell (its nearest pivot, the first of equals) and away (the distance to it)."""
    names = df.columns
    width = pivots.shape[1]

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at:at + BLOCK]
                d = _distances(_points(part["x"], width), pivots)
                cell = d.argmin(axis=1)
                yield part[names].assign(cell=cell.astype("int32"), away=d[np.arange(len(part)), cell])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["cell int", "away double"])
    return df.mapInPandas(run, schema)


def _look(points: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """(q, distance, tkey, lab): of each (q, cell) of ``queries`` the k nearest
    points of every block of the cell."""
    def blocks(df: DataFrame) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))

    sizes = materialize(blocks(points).withColumnRenamed("n", "np").join(blocks(queries).withColumnRenamed("n", "nq"), "cell"))
    sizes = F.broadcast(sizes)  # one row per pivot
    p = points.join(sizes, "cell").select("cell", "x", "tkey", "lab", F.expr("int(pmod(xxhash64(x, tkey), np))").alias("pb"),
                                          F.explode(F.expr("sequence(0, nq - 1)")).alias("qb"))
    q = queries.join(sizes, "cell").select("cell", "q", F.expr("int(pmod(xxhash64(q), nq))").alias("qb"),
                                           F.explode(F.expr("sequence(0, np - 1)")).alias("pb"))

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"q": [], "distance": [], "tkey": [], "lab": []})
        points = points.sort_values("tkey", kind="stable")
        x, y = _points(points["x"], width), _points(queries["q"], width)
        out = []
        for at in range(0, len(y), 256):
            d = _distances(y[at:at + 256], x)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]  # equal distances in order of the key
            n = best.shape[1]
            out.append(pd.DataFrame({"q": np.repeat(queries["q"].to_numpy()[at:at + 256], n), "distance": np.take_along_axis(d, best, 1).ravel(),
                                     "tkey": points["tkey"].to_numpy()[best.ravel()], "lab": points["lab"].to_numpy()[best.ravel()]}))
        return pd.concat(out)

    keys = ["cell", "pb", "qb"]
    types = dict(points.dtypes)
    return p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(
        run, f"q array<double>, distance double, tkey {types['tkey']}, lab {types['lab']}")


def _k_best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy("distance", "tkey")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str, k: int = 5,
        pivots: int = PIVOTS, seed: int = 42) -> DataFrame:
    """(q, rank, neighbour, distance, neighbour_label): the k nearest training
    rows of every distinct test point q (array of the features); fewer where
    there are no k training rows."""
    width = len(features)
    points = _complete(train, features, F.col(key).alias("tkey"), F.col(label).alias("lab"))
    copies = Window.partitionBy("x").orderBy("tkey")
    points = materialize(points.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= k).drop("_r"))
    queries = _complete(test, features).distinct().withColumnRenamed("x", "q")
    drawn = points.select("x").distinct().orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(pivots).collect()
    if not drawn:
        lab = dict(points.dtypes)
        return points.sparkSession.createDataFrame(
            [], f"q array<double>, rank int, neighbour {lab['tkey']}, distance double, neighbour_label {lab['lab']}")
    at = np.array([r["x"] for r in drawn], dtype=float).reshape(len(drawn), width)

    points = materialize(_nearest_pivot(points, at))
    radii = np.zeros(len(at))
    for r in points.groupBy("cell").agg(F.max("away").alias("far")).collect():  # one row per pivot
        radii[r["cell"]] = r["far"]
    own = materialize(_nearest_pivot(queries.withColumnRenamed("q", "x"), at).withColumnRenamed("x", "q"))
    first = materialize(_k_best(_look(points, own.select("cell", "q"), k, width), k).drop("rank"))
    # the k-th distance in the own cell; without k points there the bound is infinite
    bound = first.groupBy("q").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    bounded = own.join(bound, "q", "left").select("q", "cell", F.when(F.col("n") >= k, F.col("far")).alias("far"))
    between = _distances(at, at)

    def reached(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 1024):
                part = pdf.iloc[start:start + 1024]
                d = _distances(_points(part["q"], width), at)
                cell = part["cell"].to_numpy()
                near = d[np.arange(len(part)), cell]
                far = part["far"].to_numpy(dtype=float, na_value=np.inf) if part["far"].dtype == object else part["far"].fillna(np.inf).to_numpy()
                slack = SLACK * (d + radii[None, :] + near[:, None] + 1e-300)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d ** 2 - near[:, None] ** 2) / (2 * between[cell])
                plane_slack = SLACK * (1 + d / np.maximum(between[cell], 1e-300)) * (d + near[:, None])
                out_of_reach = (d - radii[None, :] - slack > far[:, None]) | (plane - plane_slack > far[:, None])
                out_of_reach[np.arange(len(part)), cell] = True  # looked into already
                i, j = np.nonzero(~out_of_reach)
                yield pd.DataFrame({"q": part["q"].to_numpy()[i], "cell": j.astype("int32")})

    others = materialize(bounded.mapInPandas(reached, "q array<double>, cell int"))
    found = first.unionByName(_look(points, others, k, width))
    return _k_best(found, k).select("q", "rank", F.col("tkey").alias("neighbour"), "distance", F.col("lab").alias("neighbour_label"))
