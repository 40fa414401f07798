"""Exact ranks and running totals without a single-partition window.

``row_number() over (partition by g order by o)`` puts a whole group in one
task; with a hot group (a class holding a third of the rows) that task holds a
third of the table. Here every row also carries a *bucket*: a value that is
monotone in the order (a prefix of the md5 order key, or a range bucket of
the order column) and derived from the row alone, so the plan does not
depend on physical partitioning. Null group values are a group like any other. Then
* counts per (group, bucket) form a small table (groups x buckets rows) whose
  running sums give each bucket's offset;
* rows are numbered within (group, bucket), a window whose partitions are
  ``1 / buckets`` of a group each, spread over all tasks by the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_DIGITS = 4   # 65,536 buckets for md5-ordered ranks


def hash_bucket(hex_hash: Column | str, digits: int = HASH_BUCKET_DIGITS) -> Column:
    c = F.col(hex_hash) if isinstance(hex_hash, str) else hex_hash
    return F.substring(c, 1, digits)


def range_bucket(df: DataFrame, column: str, out: str = "_qb") -> DataFrame:
    """Add ``out``: a bucket id monotone in ``column`` (nulls lowest), by one
    range partitioning into as many buckets as the session has shuffle
    partitions. Spark samples the bounds, so buckets are even whatever the
    values look like; equal values share a bucket (callers pass tables of
    distinct values or per-value counts, so ties never pile up). The bounds are
    drawn anew in each run, so the result is written to the checkpoint folder."""
    from equigroup.session import materialize
    return materialize(df.repartitionByRange(F.col(column)).withColumn(out, F.spark_partition_id()))


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where a null key meets a null key."""
    other = right.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(other[f"_key{i}"])
    return left.join(other, same, "inner").drop(*[f"_key{i}" for i in range(len(keys))])


def ranked(df: DataFrame, group_cols: list[str], order_cols: list, bucket: Column | str,
           out: str = "pos", with_group_size: str | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row within its group in the given
    order. The order must be total (end in a unique key or hash) and ``bucket``
    monotone non-decreasing in it. Optionally add the group size."""
    g = list(group_cols)
    b = df.withColumn("_b", F.col(bucket) if isinstance(bucket, str) else bucket)
    stats = b.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*g).orderBy("_b")
    stats = stats.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keep = [*g, "_b", "_off"]
    if with_group_size:
        stats = stats.withColumn(with_group_size, F.sum("_cnt").over(Window.partitionBy(*g)))
        keep.append(with_group_size)
    lw = Window.partitionBy(*g, "_b").orderBy(*_cols(order_cols))
    local = b.withColumn("_lrn", F.row_number().over(lw) - 1)
    res = _join_keys(local, stats.select(*keep), [*g, "_b"])
    return res.withColumn(out, (F.col("_lrn") + F.col("_off")).cast("bigint")).drop("_b", "_lrn", "_off")


def running_total(df: DataFrame, group_cols: list[str], order_cols: list, value: str,
                  bucket: Column | str, out: str = "before") -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows strictly before each row
    within its group, in the given total order (``bucket`` monotone in it)."""
    g = list(group_cols)
    b = df.withColumn("_b", F.col(bucket) if isinstance(bucket, str) else bucket)
    stats = b.groupBy(*g, "_b").agg(F.sum(value).alias("_tot"))
    w = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_tot").over(w), F.lit(0))).drop("_tot")
    lw = Window.partitionBy(*g, "_b").orderBy(*_cols(order_cols)).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumn("_local", F.coalesce(F.sum(value).over(lw), F.lit(0)))
    res = _join_keys(local, stats, [*g, "_b"])
    return res.withColumn(out, F.col("_local") + F.col("_off")).drop("_b", "_local", "_off")
