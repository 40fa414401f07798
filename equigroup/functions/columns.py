"""Generic column helpers: rounding for comparison, usable-value filter,
value symbols for counting, null-safe masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (and doubles in no other place) to ``digits``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def usable(c: Column, eps: float = 0.0) -> Column:
    """The value when it is usable for a report mean, else NULL: not null,
    not NaN, not infinite, not 0 and (optionally) not below ``eps`` in size."""
    d = c.cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))) & (d != 0.0)
    if eps > 0:
        ok = ok & (F.abs(d) >= F.lit(eps))
    return F.when(ok, d)


def symbol(c: Column, dt: T.DataType) -> Column:
    """A 64-bit symbol for a value, NULL for NULL, used to count distinct values
    of mixed-type columns together without formatting them as text.
    -0.0 and 0.0 are one value, as are all NaNs."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        c = c.cast("double")
        c = F.when(c == 0.0, F.lit(0.0)).when(F.isnan(c), F.lit(float("nan"))).otherwise(c)
    return F.when(c.isNull(), F.lit(None).cast("long")).otherwise(F.xxhash64(c))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def symbol_sql(name: str, dt: T.DataType) -> str:
    """SQL text of ``symbol`` (one expression string: cheap to build for
    hundreds of columns)."""
    c = quote(name)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        c = (f"(case when cast({c} as double) = 0.0 then 0.0D when isnan(cast({c} as double)) "
             f"then double('NaN') else cast({c} as double) end)")
    return f"(case when {quote(name)} is null then cast(null as bigint) else xxhash64({c}) end)"


def privileged(c: Column, value) -> Column:
    """Privileged mask; a NULL sensitive value counts as unprivileged."""
    return F.coalesce(c == F.lit(value), F.lit(False))


def safe_div(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)
