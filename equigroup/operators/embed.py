"""Group embedding apply side (B3-B5): encoder weights as small tables,
applied as generated column expressions (no Python in the row path).

Tables: ``moments`` (feature, mean, scale); ``encoder`` (group_id, feature,
dim, w); ``enc_bias`` (group_id, dim, b); ``decoder`` (group_id, dim, feature,
w); ``dec_bias`` (group_id, feature, b). Their size is bounded by the number
of features, so they are collected once to generate the expressions.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.functions.columns import quote

ACTIVATIONS = {
    "relu": "greatest(0.0D, {z})",
    "identity": "{z}",
    "logistic": "1.0D / (1.0D + exp(-({z})))",
    "tanh": "tanh({z})",
}


def latent_name(group_id: int, dim: int, n_dims: int) -> str:
    return f"group_{group_id}" if n_dims == 1 else f"group_{group_id}_dim{dim}"


def _collect(df: DataFrame) -> list:
    return [r.asDict() for r in df.collect()]


def encode(df: DataFrame, moments: DataFrame, encoder: DataFrame, enc_bias: DataFrame,
           keep: list[str] = (), activation: str = "relu") -> DataFrame:
    """Latent columns act(((x - mean) / scale) W + b) per group and dim."""
    mom = {r["feature"]: (r["mean"], r["scale"]) for r in _collect(moments)}
    w = defaultdict(list)
    for r in _collect(encoder):
        w[(r["group_id"], r["dim"])].append((r["feature"], r["w"]))
    b = {(r["group_id"], r["dim"]): r["b"] for r in _collect(enc_bias)}
    dims = defaultdict(set)
    for g, d in w:
        dims[g].add(d)
    missing = {f for terms in w.values() for f, _ in terms} - set(df.columns)
    if missing:
        raise KeyError(f"features missing from the table: {sorted(missing)}")
    act = ACTIVATIONS[activation]
    out = []
    for g in sorted(dims):
        for d in sorted(dims[g]):
            z = " + ".join(f"{wt!r}D * ((cast({quote(f)} as double) - {mom[f][0]!r}D) / {mom[f][1]!r}D)"
                           for f, wt in w[(g, d)])
            z = f"({z} + {b.get((g, d), 0.0)!r}D)"
            out.append(f"{act.format(z=z)} as `{latent_name(g, d, len(dims[g]))}`")
    return df.selectExpr(*[quote(k) for k in keep], *out)


def reconstruction_mse(df: DataFrame, moments: DataFrame, encoder: DataFrame, enc_bias: DataFrame,
                       decoder: DataFrame, dec_bias: DataFrame, activation: str = "relu") -> DataFrame:
    """Mean over rows and features of the squared error between the scaled
    input and its decoding (linear output layer)."""
    mom = {r["feature"]: (r["mean"], r["scale"]) for r in _collect(moments)}
    dims = defaultdict(set)
    for r in _collect(encoder):
        dims[r["group_id"]].add(r["dim"])
    lat = encode(df, moments, encoder, enc_bias, keep=list(mom), activation=activation)
    dec = defaultdict(list)
    for r in _collect(decoder):
        dec[(r["group_id"], r["feature"])].append((r["dim"], r["w"]))
    db = {(r["group_id"], r["feature"]): r["b"] for r in _collect(dec_bias)}
    errs = []
    for (g, f), terms in sorted(dec.items()):
        xhat = " + ".join(f"{wt!r}D * `{latent_name(g, d, len(dims[g]))}`" for d, wt in terms)
        xhat = f"({xhat} + {db.get((g, f), 0.0)!r}D)"
        z = f"((cast({quote(f)} as double) - {mom[f][0]!r}D) / {mom[f][1]!r}D)"
        errs.append(f"power({z} - {xhat}, 2)")
    return lat.selectExpr(f"({' + '.join(errs)}) / {len(errs)} as _e").agg(F.avg("_e").alias("mse"))


def moments_table(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, scale) with population std, 0 -> 1."""
    one = df.selectExpr(*[f"named_struct('feature', '{f}', 'mean', avg(cast({quote(f)} as double)), "
                          f"'scale', coalesce(nullif(stddev_pop(cast({quote(f)} as double)), 0.0D), 1.0D)) as `{f}`"
                          for f in features])
    return one.selectExpr(f"inline(array({', '.join(quote(f) for f in features)}))")
