"""Information theory over feature columns (plug-in estimates, base-2 logs).

Plan shape (scales with rows, not with the square of rows):
* every row is one array of value symbols; a task counts the cells of all pairs
  batch by batch on dictionary codes (``functions.cells``) and ships one row per
  distinct cell;
* conditional mutual information is assembled from entropies of the pair
  contingency table, ``I(X;Y|Z) = (S_xyz + S_z - S_xz - S_yz) / N`` with
  ``S = sum n log2 n`` over the cells of each marginal, which needs only
  aggregations (no windows, no joins back to the data);
* nulls are dropped pairwise (a row counts for a pair when x, y and z are set).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from equigroup.functions.cells import count_cells
from equigroup.functions.columns import quote, symbol_sql
from equigroup.vocab import DISSIM_EPS


def _str_array(values: list[str]) -> F.Column:
    return F.expr("array(" + ",".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")")


def _names_col(names: list[str], idx) -> F.Column:
    return F.element_at(_str_array(names), idx + 1)


def _nlogn(c):
    return c * F.log2(c)


def _symbols(df: DataFrame, features: list[str]) -> F.Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.expr("array(" + ",".join(symbol_sql(c, types[c]) for c in features) + ")")


def entropy(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, entropy) per feature over its non-null values."""
    return _entropy_from(cell_counts(df, features, None), features)


def cell_counts(df: DataFrame, features: list[str], target: str | None, segment: str | None = None) -> DataFrame:
    """(a, b, x, y, z, n) from ONE scan: pair cells (a < b feature indices,
    counted where x, y and z are set) and single-feature cells (b = -1, y = z
    = 0, counted where x is set); with ``segment``, for each of its values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)] if target else []
    z = F.expr(symbol_sql(target, types[target])) if target else F.lit(0).cast("long")
    s = F.col(quote(segment)) if segment else F.lit(0)
    kind = types[segment].simpleString() if segment else "int"
    arrow = to_arrow_type(types[segment]) if segment else pa.int32()
    rows = df.select(s.alias("s"), _symbols(df, features).alias("_v"), z.alias("_z"))
    sg = [F.col("s").alias(segment)] if segment else []
    cells = rows.mapInArrow(lambda batches: count_cells(batches, p, pairs, arrow),
                            f"s {kind}, a int, b int, x long, y long, z long, n long")
    return cells.groupBy(*sg, "a", "b", "x", "y", "z").agg(F.sum("n").alias("n"))


def _entropy_from(counts: DataFrame, features: list[str]) -> DataFrame:
    per = (counts.filter(F.col("b") == -1)
                 .groupBy("a").agg(F.sum("n").alias("n"), F.sum(_nlogn(F.col("n").cast("double"))).alias("s")))
    return per.select(_names_col(features, F.col("a")).alias("feature"),
                      F.col("n").cast("bigint").alias("n"),
                      (F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n")).alias("entropy"))


def _cmi_from(counts: DataFrame, features: list[str]) -> DataFrame:
    t = counts.filter(F.col("b") >= 0)
    # tag 0: (x,y,z) +, 1: (x,z) -, 2: (y,z) -, 3: (z) +
    tagged = t.select("a", "b", "z", "n", F.explode(F.array(
        F.struct(F.lit(0).alias("tag"), F.col("x").alias("u"), F.col("y").alias("v")),
        F.struct(F.lit(1).alias("tag"), F.col("x").alias("u"), F.lit(None).cast("long").alias("v")),
        F.struct(F.lit(2).alias("tag"), F.lit(None).cast("long").alias("u"), F.col("y").alias("v")),
        F.struct(F.lit(3).alias("tag"), F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v")),
    )).alias("m")).select("a", "b", "z", "n", "m.tag", "m.u", "m.v")
    marg = tagged.groupBy("a", "b", "tag", "u", "v", "z").agg(F.sum("n").alias("m"))
    sign = F.when(F.col("tag").isin(0, 3), F.lit(1.0)).otherwise(F.lit(-1.0))
    per = marg.groupBy("a", "b").agg(
        F.sum(sign * _nlogn(F.col("m").cast("double"))).alias("s"),
        F.sum(F.when(F.col("tag") == 0, F.col("m"))).alias("n"))
    ni, nj = _names_col(features, F.col("a")), _names_col(features, F.col("b"))
    cmi = F.greatest(F.col("s") / F.col("n"), F.lit(0.0))
    return per.select(F.least(ni, nj).alias("fi"), F.greatest(ni, nj).alias("fj"), "a", "b",
                      F.col("n").cast("bigint").alias("n"), cmi.alias("cmi"))


def pair_contingency(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(a, b, x, y, z, n): counts per feature-pair cell, a < b feature indices."""
    if len(features) < 2:
        raise ValueError("need at least two features")
    return cell_counts(df, features, target).filter(F.col("b") >= 0)


def conditional_mutual_information(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(fi, fj, a, b, n, cmi) per unordered feature pair, fi < fj by name."""
    return _cmi_from(pair_contingency(df, features, target), features)


def dissimilarity(df: DataFrame, features: list[str], target: str,
                  with_parts: bool = False, segment: str | None = None) -> DataFrame:
    """Feature dissimilarity 1 - I(X;Y|Z) / (H(X) + H(Y) + 1e-9), long form
    (fi, fj, dissimilarity) with fi < fj; symmetric with zero diagonal.
    With ``segment``, one matrix per value of that column, all in one job.

    One lineage, one scan: the cell counts feed one marginal aggregation in
    which single-feature cells carry their own tag, giving a small table with
    one row per feature (entropy) and per pair (CMI); entropies are attached
    to the pairs by a window over that small table (no split of the lineage,
    which the optimizer would otherwise turn into a second scan)."""
    if len(features) < 2:
        raise ValueError("need at least two features")
    sg = [segment] if segment else []
    counts = cell_counts(df, features, target, segment)
    nl = F.lit(None).cast("long")
    pair_tags = F.array(
        F.struct(F.lit(0).alias("tag"), F.col("x").alias("u"), F.col("y").alias("v")),
        F.struct(F.lit(1).alias("tag"), F.col("x").alias("u"), nl.alias("v")),
        F.struct(F.lit(2).alias("tag"), nl.alias("u"), F.col("y").alias("v")),
        F.struct(F.lit(3).alias("tag"), nl.alias("u"), nl.alias("v")))
    single_tag = F.array(F.struct(F.lit(4).alias("tag"), F.col("x").alias("u"), nl.alias("v")))
    tagged = counts.select(*sg, "a", "b", "z", "n",
                           F.explode(F.when(F.col("b") >= 0, pair_tags).otherwise(single_tag)).alias("m")) \
                   .select(*sg, "a", "b", "z", "n", "m.tag", "m.u", "m.v")
    marg = tagged.groupBy(*sg, "a", "b", "tag", "u", "v", "z").agg(F.sum("n").alias("m"))
    sign = F.when(F.col("tag").isin(1, 2), F.lit(-1.0)).otherwise(F.lit(1.0))
    per = marg.groupBy(*sg, "a", "b").agg(
        F.sum(sign * _nlogn(F.col("m").cast("double"))).alias("s"),
        F.sum(F.when(F.col("tag").isin(0, 4), F.col("m"))).alias("n"))
    value = F.when(F.col("b") < 0, F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n")) \
             .otherwise(F.greatest(F.col("s") / F.col("n"), F.lit(0.0)))
    per = per.select(*sg, "a", "b", value.alias("value"))
    roles = per.select(*sg, "a", "b", "value", F.explode(F.when(
        F.col("b") < 0, F.array(F.struct(F.col("a").alias("f"), F.lit(0).alias("role"))))
        .otherwise(F.array(F.struct(F.col("a").alias("f"), F.lit(1).alias("role")),
                           F.struct(F.col("b").alias("f"), F.lit(2).alias("role"))))).alias("r")) \
        .select(*sg, "a", "b", "value", "r.f", "r.role")
    roles = roles.withColumn("h", F.max(F.when(F.col("role") == 0, F.col("value")))
                             .over(Window.partitionBy(*sg, "f")))
    pairs = roles.filter(F.col("role") > 0).groupBy(*sg, "a", "b").agg(
        F.first("value").alias("cmi"), F.max(F.when(F.col("role") == 1, F.col("h"))).alias("h_i"),
        F.max(F.when(F.col("role") == 2, F.col("h"))).alias("h_j"))
    ni, nj = _names_col(features, F.col("a")), _names_col(features, F.col("b"))
    out = pairs.select(*sg, F.least(ni, nj).alias("fi"), F.greatest(ni, nj).alias("fj"), "cmi",
                       F.when(ni <= nj, F.col("h_i")).otherwise(F.col("h_j")).alias("h_i"),
                       F.when(ni <= nj, F.col("h_j")).otherwise(F.col("h_i")).alias("h_j"))
    out = out.withColumn("dissimilarity",
                         F.lit(1.0) - F.col("cmi") / (F.col("h_i") + F.col("h_j") + F.lit(DISSIM_EPS)))
    cols = [*sg, "fi", "fj", "dissimilarity"] + (["cmi", "h_i", "h_j"] if with_parts else [])
    return out.select(*cols)


def mirrored(matrix: DataFrame, value: str = "dissimilarity", diagonal: bool = False) -> DataFrame:
    """Both orientations of a long upper-triangle matrix (optionally + zero diagonal)."""
    up = matrix.select("fi", "fj", value)
    lo = matrix.select(F.col("fj").alias("fi"), F.col("fi").alias("fj"), value)
    full = up.unionByName(lo)
    if diagonal:
        feats = up.select(F.col("fi").alias("f")).union(up.select(F.col("fj").alias("f"))).distinct()
        full = full.unionByName(feats.select(F.col("f").alias("fi"), F.col("f").alias("fj"),
                                             F.lit(0.0).alias(value)))
    return full


def centred_gram(matrix: DataFrame, value: str = "dissimilarity") -> DataFrame:
    """Double centring G = -0.5 H D^2 H of a dissimilarity matrix: row, column
    and grand means of D^2 as small aggregates joined back. Full p x p output."""
    d2 = mirrored(matrix, value, diagonal=True).withColumn("d2", F.col(value) * F.col(value))
    row = d2.groupBy("fi").agg(F.avg("d2").alias("r_i"))
    col = row.select(F.col("fi").alias("fj"), F.col("r_i").alias("r_j"))
    grand = d2.agg(F.avg("d2").alias("g"))
    return (d2.join(row, "fi").join(col, "fj").crossJoin(F.broadcast(grand))
              .select("fi", "fj", (F.lit(-0.5) * (F.col("d2") - F.col("r_i") - F.col("r_j") + F.col("g")))
                      .alias("gram")))


_EIG_SCHEMA = T.StructType([
    T.StructField("component", T.IntegerType()), T.StructField("eigenvalue", T.DoubleType()),
    T.StructField("explained", T.DoubleType()), T.StructField("cumulative", T.DoubleType()),
    T.StructField("top3_share", T.DoubleType()), T.StructField("is_euclidean", T.BooleanType()),
    T.StructField("min_eigenvalue", T.DoubleType())])


def _eigen(pdf: pd.DataFrame) -> pd.DataFrame:
    names = sorted(set(pdf["fi"]))
    idx = {n: i for i, n in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    g[pdf["fi"].map(idx).to_numpy(), pdf["fj"].map(idx).to_numpy()] = pdf["gram"].to_numpy()
    ev = np.linalg.eigvalsh(g)
    pos = np.sort(ev[ev > 1e-8])[::-1]  # a centred matrix has a zero; its rounding is no component
    tot = pos.sum() if len(pos) else np.nan
    ratio = pos / tot if len(pos) else pos
    return pd.DataFrame({
        "component": np.arange(1, len(pos) + 1, dtype=np.int32),
        "eigenvalue": pos, "explained": ratio, "cumulative": np.cumsum(ratio),
        "top3_share": np.full(len(pos), pos[:3].sum() / tot if len(pos) else np.nan),
        "is_euclidean": np.full(len(pos), bool(np.all(ev >= -1e-8))),
        "min_eigenvalue": np.full(len(pos), float(ev.min()) if len(ev) else np.nan)})


def gram_spectrum(gram: DataFrame) -> DataFrame:
    """Eigenvalues of the centred Gram matrix (p x p, one Python worker per
    matrix; p is the number of features, bounded by the schema): positive
    eigenvalues in descending order with explained and cumulative shares."""
    return (gram.withColumn("_seg", F.lit(0)).groupBy("_seg")
                .applyInPandas(_eigen, _EIG_SCHEMA))
