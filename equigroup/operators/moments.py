"""Per-feature moments and the feature Gram matrix (G9, G10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def skew_kurtosis(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, skewness, kurtosis): population skewness and excess kurtosis.
    Two passes of plain sums (codegen-friendly): means, then centred power
    sums against the broadcast one-row mean table (numerically stable)."""
    q = {c: "`" + c.replace("`", "``") + "`" for c in features}
    mu = df.selectExpr(*[f"avg(cast({q[c]} as double)) as `{c}__mu`" for c in features])
    x = df.crossJoin(F.broadcast(mu))
    aggs = []
    for c in features:
        d = f"(cast({q[c]} as double) - `{c}__mu`)"
        aggs += [f"count({q[c]}) as `{c}__n`", f"sum({d} * {d}) as `{c}__2`",
                 f"sum({d} * {d} * {d}) as `{c}__3`", f"sum({d} * {d} * {d} * {d}) as `{c}__4`"]
    one = x.selectExpr(*aggs)
    structs = []
    for c in features:
        m2, m3, m4 = (f"(`{c}__{i}` / `{c}__n`)" for i in (2, 3, 4))
        lit = "'" + c.replace("'", "\\'") + "'"
        structs.append(f"named_struct('feature', {lit}, 'skewness', try_divide({m3}, power({m2}, 1.5)), "
                       f"'kurtosis', try_divide({m4}, {m2} * {m2}) - 3.0D)")
    return one.selectExpr(f"inline(array({', '.join(structs)}))")


def feature_gram(df: DataFrame, features: list[str]) -> DataFrame:
    """(fi, fj, gram) = sum over rows of x_i * x_j, fi <= fj by name.
    Each partition multiplies its Arrow batches (X^T X, numpy) and emits one
    p x p partial; a grouped sum adds the partials. Rows with a null in any
    listed feature are skipped."""
    p = len(features)
    iu, ju = np.triu_indices(p)
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                           T.StructField("v", T.DoubleType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((p, p))
        seen = False
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            x = x[~np.isnan(x).any(axis=1)]
            if len(x):
                acc += x.T @ x
                seen = True
        if seen:
            yield pd.DataFrame({"i": iu.astype(np.int32), "j": ju.astype(np.int32), "v": acc[iu, ju]})

    parts = df.selectExpr(*[f"cast(`{c}` as double) as `{c}`" for c in features]).mapInPandas(partial, schema)
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("gram"))
    names = F.expr("array(" + ",".join("'" + n + "'" for n in features) + ")")
    ni, nj = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    return sums.select(F.least(ni, nj).alias("fi"), F.greatest(ni, nj).alias("fj"), "gram")
