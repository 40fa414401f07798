"""Query registry: ``@query("i3_dissimilarity")`` registers a (spark, sf_dir)
callable; doubles are rounded to 6 digits (and -0.0 folded to 0.0) so results
compare exactly with the SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        q = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(f"round(cast({q} as double), {digits}) + 0.0D as {q}")
        else:
            cols.append(q)
    return df.selectExpr(*cols)


def query(name: str, rounded: bool = True):
    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = fn(spark, sf)
            return finish(out) if rounded else out
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco
