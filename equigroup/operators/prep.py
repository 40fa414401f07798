"""Projections, null handling, encoding and scaling (inventory 2.2 and 2.5).

Fitting (category lists, moments) is one aggregate whose result is bounded by
the schema (a category list per nominal column, two numbers per numeric
column); applying is a single generated ``select`` so the whole transform is
one whole-stage-codegen span with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equigroup.functions.columns import is_numeric
from equigroup.functions.ordering import range_bucket, ranked
from equigroup.spec import CohortSpec

# ------------------------------------------------------------------ P1-P13


def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in set(exclude)]


def select_numeric(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    return df.select(*numeric_columns(df, exclude))


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def split_by_null(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows where column is null, rows where it is set)."""
    return df.filter(F.col(column).isNull()), df.filter(F.col(column).isNotNull())


def target_last(df: DataFrame, target: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != target], target)


def strip_prefix_int(c: Column | str, prefix_len: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.substring(col, prefix_len + 1, 1 << 30).try_cast("bigint")


def null_audit(df: DataFrame) -> DataFrame:
    """One row: number of nulls per column (one aggregate pass)."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).cast("bigint").alias(c) for c in df.columns])


def assert_no_nulls(df: DataFrame) -> None:
    row = null_audit(df).first()
    bad = {k: v for k, v in row.asDict().items() if v}
    if bad:
        raise ValueError(f"nulls left after cleaning: {bad}")


def feature_variance(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, variance) with sample variance, one aggregate pass; the one
    result row is unpivoted (p rows)."""
    one = df.selectExpr(*[f"var_samp(cast({_q(c)} as double)) as {_q(c)}" for c in features])
    return one.unpivot([], features, "feature", "variance")


def non_constant_features(df: DataFrame, features: list[str]) -> DataFrame:
    return feature_variance(df, features).filter(F.col("variance") > 0)


def feature_presence(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """assignment (group_id, feature) + present flag against df's columns."""
    cols = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return (assignment.join(F.broadcast(cols), assignment.feature == cols.column, "left")
                      .select("group_id", "feature", F.col("column").isNotNull().alias("present")))


def deviation_filter(df: DataFrame, value: str, group: Column, alpha: float, out: str = "deviation") -> DataFrame:
    """Rows whose value deviates from its group's mean by more than alpha.
    Group means come from a grouped aggregate joined back (no window over a
    possibly hot group)."""
    g = df.withColumn("_g", group)
    means = g.groupBy("_g").agg(F.avg(value).alias("_mu"))
    return (g.join(means, "_g")
             .withColumn(out, F.col(value) - F.col("_mu"))
             .filter(F.abs(F.col(out)) > F.lit(alpha)).drop("_g", "_mu"))


# ------------------------------------------------------------------ E1-E7


def fit_categories(df: DataFrame, column: str, most: int = 10_000) -> list:
    """Sorted distinct non-null values (UTF-8 byte order for strings). They
    become columns or literals of a plan, so more than ``most`` is an error."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct()
             .orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} different values: use label_code")
    return found


def one_hot_columns(column: str, categories: list) -> list[Column]:
    c = F.col(column)
    return [F.when(c == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{column}_{v}") for v in categories]


def code_map(levels: list) -> Column:
    return F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(i))])


def label_code_column(column: str, categories: list) -> Column:
    return code_map(categories)[F.col(column)].cast("int").alias(column)


def ordinal_code_column(column: str, levels: list, is_target: bool = False) -> Column:
    looked = code_map(levels)[F.col(column)]
    if is_target:
        return F.coalesce(looked, F.lit(-1)).cast("int").alias(column)
    err = F.raise_error(F.concat(F.lit(f"unknown level for {column}: "), F.col(column).cast("string")))
    return (F.when(F.col(column).isNull(), F.lit(None).cast("double"))
             .when(looked.isNull(), err.cast("double"))
             .otherwise(looked.cast("double")).alias(column))


def one_hot(df: DataFrame, column: str, categories: list | None = None) -> DataFrame:
    cats = categories if categories is not None else fit_categories(df, column)
    return df.select(*[x for x in df.columns if x != column], *one_hot_columns(column, cats))


def label_code(df: DataFrame, column: str, categories: list | None = None) -> DataFrame:
    """Code 0..n-1 by sorted value, null for null. The distinct values are
    range partitioned, ranked and joined back, whatever their number; a given
    (fitted) category list is applied as a literal instead."""
    if categories is not None:
        return df.select(*[label_code_column(x, categories) if x == column else F.col(x) for x in df.columns])
    vals = df.select(F.col(column).alias("_v")).where("_v IS NOT NULL").distinct()
    codes = ranked(range_bucket(vals, "_v", "_vb"), [], ["_v"], "_vb", out="_code").select("_v", "_code")
    j = df.join(codes, F.col(column) == F.col("_v"), "left")
    return j.select(*[F.col("_code").alias(x) if x == column else F.col(x) for x in df.columns])


def ordinal_code(df: DataFrame, column: str, levels: list, is_target: bool = False) -> DataFrame:
    return df.select(*[ordinal_code_column(x, levels, is_target) if x == column else F.col(x)
                       for x in df.columns])


def encode_list(df: DataFrame, nominals: list[str], fitted: dict | None = None) -> DataFrame:
    """Trailing '!' = label code, else one-hot; built as one select."""
    fitted = dict(fitted or {})
    plan = {}
    for spec in nominals:
        name = spec.strip()
        target = name.endswith("!")
        name = name[:-1] if target else name
        cats = fitted.get(name) or fit_categories(df, name)
        plan[name] = (target, cats)
    out = []
    tail = []
    for c in df.columns:
        if c not in plan:
            out.append(F.col(c))
        elif plan[c][0]:
            out.append(label_code_column(c, plan[c][1]))
        else:
            tail.extend(one_hot_columns(c, plan[c][1]))
    return df.select(*out, *tail)


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def fit_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std per column (std 0 -> 1)."""
    aggs = []
    for c in cols:
        x = f"cast({_q(c)} as double)"
        aggs += [f"avg({x}) as `{c}__mean`",
                 f"coalesce(nullif(stddev_pop({x}), 0.0D), 1.0D) as `{c}__scale`"]
    return df.selectExpr(*aggs)


def apply_zscore(df: DataFrame, cols: list[str], moments: DataFrame) -> DataFrame:
    j = df.crossJoin(F.broadcast(moments))
    cs = set(cols)
    return j.selectExpr(*[f"(cast({_q(c)} as double) - `{c}__mean`) / `{c}__scale` as {_q(c)}"
                          if c in cs else _q(c) for c in df.columns])


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply_zscore(df, cols, fit_moments(df, cols))


def fit_encoding(df: DataFrame, spec: CohortSpec) -> dict:
    fitted = {}
    for n in spec.nominal:
        name = n.rstrip("!").strip()
        fitted[name] = fit_categories(df, name)
    if spec.target not in spec.ordinal and spec.target_ordinal is None:
        fitted.setdefault(spec.target, fit_categories(df, spec.target))
    return fitted


def encode_cohort(df: DataFrame, spec: CohortSpec, fitted: dict | None = None) -> DataFrame:
    """Spec-driven encoding: drops, one-hot / label-coded nominals, ordinal codes,
    target coded (label code, or ordinal with unknown -> -1), target last."""
    fitted = fitted or fit_encoding(df, spec)
    out, tail = [], []
    for c in df.columns:
        if c in spec.drop:
            continue
        if c == spec.target:
            continue
        nom = next((n for n in spec.nominal if n.rstrip("!").strip() == c), None)
        if nom is not None:
            if nom.endswith("!"):
                out.append(label_code_column(c, fitted[c]))
            else:
                tail.extend(one_hot_columns(c, fitted[c]))
        elif c in spec.ordinal:
            out.append(ordinal_code_column(c, spec.ordinal[c]))
        else:
            out.append(F.col(c))
    if spec.target_ordinal is not None:
        tcol = ordinal_code_column(spec.target, spec.target_ordinal, is_target=True)
    else:
        tcol = label_code_column(spec.target, fitted[spec.target])
    return df.select(*out, *tail, tcol)
