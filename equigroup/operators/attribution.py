"""Attribution (inventory 2.12) on long tables ``(key, class, feature, phi)``.

Per-row work is generated column arithmetic (one ``inline`` of p structs per
row); every summary is a grouped aggregate. Percentiles are exact, from counts
of narrowing value ranges (``functions.quantiles``); null attributions are left
out of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equigroup.functions.columns import quote
from equigroup.functions.quantiles import percentiles


def linear_attribution(df: DataFrame, key: str, coefs: dict, background: DataFrame | None = None) -> DataFrame:
    """Exact attributions of a linear model with independent features:
    phi = coef * (x - mean_background(x)). ``coefs`` maps class -> {feature:
    coef}. Output (key, class, feature, phi)."""
    feats = sorted({f for per in coefs.values() for f in per})
    bg = (background if background is not None else df).selectExpr(
        *[f"avg(cast({quote(f)} as double)) as `{f}__bg`" for f in feats])
    j = df.crossJoin(F.broadcast(bg))
    structs = []
    for cls, per in coefs.items():
        for f, w in per.items():
            lit = "'" + f.replace("'", "\\'") + "'"
            structs.append(f"named_struct('class', {int(cls)}, 'feature', {lit}, 'phi', "
                           f"{float(w)!r}D * (cast({quote(f)} as double) - `{f}__bg`))")
    return j.selectExpr(quote(key), f"inline(array({', '.join(structs)}))")


def linear_output(df: DataFrame, coefs: dict, intercepts: dict | None = None) -> DataFrame:
    """Model output per class for the same linear form (for checks)."""
    out = []
    for cls, per in coefs.items():
        terms = " + ".join(f"{float(w)!r}D * cast({quote(f)} as double)" for f, w in per.items())
        out.append(f"{float((intercepts or {}).get(cls, 0.0))!r}D + {terms} as `f_{int(cls)}`")
    return df.selectExpr("*", *out)


def decoder_weights(decoder: DataFrame) -> DataFrame:
    """Normalised latent -> feature weights |w| / sum over dims of |w| (a zero
    sum divides by 1). ``decoder`` is (group_id, dim, feature, w)."""
    tot = decoder.groupBy("group_id", "feature").agg(F.sum(F.abs("w")).alias("_tot"))
    return (decoder.join(tot, ["group_id", "feature"])
                   .select("group_id", "dim", "feature",
                           (F.abs("w") / F.when(F.col("_tot") == 0, F.lit(1.0)).otherwise(F.col("_tot")))
                           .alias("weight")))


def decompose(latent_phi: DataFrame, decoder: DataFrame, key: str) -> DataFrame:
    """Push latent attributions (key, class, group_id, dim, phi) to the original
    features: sum over the group's dims of phi * weight."""
    w = decoder_weights(decoder)
    return (latent_phi.join(F.broadcast(w), ["group_id", "dim"])
                      .groupBy(key, "class", "feature").agg(F.sum(F.col("phi") * F.col("weight")).alias("phi")))


def collapse_classes(attr: DataFrame, key: str, class_weights: dict | None = None) -> DataFrame:
    """One value per (key, feature): weighted sum over classes when weights are
    given, else the sum of absolute values."""
    if class_weights:
        w = F.create_map(*[x for c, v in class_weights.items() for x in (F.lit(int(c)), F.lit(float(v)))])
        val = F.sum(F.col("phi") * w[F.col("class")])
    else:
        val = F.sum(F.abs("phi"))
    return attr.groupBy(key, "feature").agg(val.alias("phi"))


def feature_ranges(attr: DataFrame, lower: float = 5, upper: float = 95, by: list[str] = ()) -> DataFrame:
    """(by..., feature, range, rank): p_upper - p_lower per feature, ranked
    by range (largest first)."""
    by = list(by)
    p = percentiles(attr, [*by, "feature"], "phi", [lower / 100.0, upper / 100.0])
    r = p.groupBy(*by, "feature").agg(
        (F.max(F.when(F.col("q") == upper / 100.0, F.col("value")))
         - F.max(F.when(F.col("q") == lower / 100.0, F.col("value")))).alias("range"))
    w = Window.partitionBy(*by).orderBy(F.col("range").desc(), F.col("feature"))
    return r.withColumn("rank", F.row_number().over(w).cast("int"))


def range_stats(ranges: DataFrame, by: list[str] = ()) -> DataFrame:
    """max, min, mean and population std of the per-feature ranges."""
    return ranges.groupBy(*by).agg(F.max("range").alias("max"), F.min("range").alias("min"),
                                   F.avg("range").alias("mean"), F.stddev_pop("range").alias("std"))


def importance(attr: DataFrame, top: int = 10, by: list[str] = ("class",)) -> DataFrame:
    """Mean |phi| per (by..., feature), the ``top`` most important per group."""
    by = list(by)
    imp = attr.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("importance"))
    w = Window.partitionBy(*by).orderBy(F.col("importance").desc(), F.col("feature"))
    return imp.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= top)
