"""Samples, hold-outs and folds (inventory 2.3), all hash-driven so they are
reproducible and checkable: order = md5(key|seed). Exact ranks come from
``ranked`` (hash buckets of the order key with offsets), never from a window
over a whole class."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equigroup.functions.hashing import hash_below, hash_int, key_hash, salted_hash
from equigroup.functions.ordering import hash_bucket, ranked


def draw_test_from_clean(raw: DataFrame, clean: DataFrame, key: str, base_fraction: float = 0.2,
                         seed: int = 42) -> DataFrame:
    """Test rows drawn from the clean rows so that they make up ``base_fraction``
    of the raw row count: n = round_half_even(frac * n_clean) with
    frac = base_fraction * n_raw / n_clean (error when frac > 1); the rows
    with the smallest md5(key|seed) are taken."""
    counts = (raw.agg(F.count(F.lit(1)).alias("_n_raw"))
                 .crossJoin(clean.agg(F.count(F.lit(1)).alias("_n_clean"))))
    frac = F.lit(base_fraction) * F.col("_n_raw") / F.col("_n_clean")
    counts = counts.select(
        F.when(frac > 1, F.raise_error(F.lit("the clean rows are fewer than the test rows asked for")))
         .otherwise(F.bround(frac * F.col("_n_clean"), 0)).cast("bigint").alias("_take"))
    r = ranked(clean.withColumn("_h", key_hash(key, seed)), [], ["_h"], hash_bucket("_h"), out="_pos")
    return (r.crossJoin(F.broadcast(counts)).filter(F.col("_pos") < F.col("_take"))
             .drop("_h", "_pos", "_take"))


def train_minus_test(raw: DataFrame, test: DataFrame, key: str) -> DataFrame:
    return raw.join(test.select(key), key, "left_anti")


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi").agg(F.count(F.lit(1)).cast("bigint").alias("n_overlap"))


def stratified_holdout(df: DataFrame, label: str, key: str, fraction: float = 0.15,
                       seed: int = 42, out: str = "is_test") -> DataFrame:
    """Flag round(fraction * n_class) rows per class as test (smallest md5)."""
    r = ranked(df.withColumn("_h", key_hash(key, seed)), [label], ["_h"], hash_bucket("_h"),
               out="_pos", with_group_size="_n")
    return (r.withColumn(out, F.col("_pos") < F.round(F.lit(fraction) * F.col("_n"), 0))
             .drop("_h", "_pos", "_n"))


def random_holdout(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 42,
                   out: str = "is_test") -> DataFrame:
    """Hash threshold: no shuffle, no global sort; about ``fraction`` of rows."""
    return df.withColumn(out, hash_below(key, fraction, seed))


def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """fold = (rank within class by md5) mod k: folds differ by <= 1 per class."""
    r = ranked(df.withColumn("_h", key_hash(key, seed)), [label], ["_h"], hash_bucket("_h"), out="_pos")
    return r.withColumn(out, (F.col("_pos") % k).cast("int")).drop("_h", "_pos")


def repeated_folds(df: DataFrame, label: str, key: str, k: int = 5, repeats: int = 10, seed: int = 42,
                   out: str = "folds") -> DataFrame:
    """``df`` once, with an array of its fold in each repeat (repeat r hashed by
    seed + r). Only key and label are ranked ``repeats`` times."""
    reps = df.sparkSession.range(repeats).select(F.col("id").cast("int").alias("repeat"))
    x = df.select(key, label).crossJoin(F.broadcast(reps))  # ``repeats`` rows
    x = x.withColumn("_h", salted_hash(key, F.lit(seed) + F.col("repeat")))
    r = ranked(x, ["repeat", label], ["_h"], hash_bucket("_h"), out="_pos")
    fold = F.struct("repeat", (F.col("_pos") % k).cast("int").alias("fold"))
    folds = r.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(fold))["fold"].alias(out))  # ``repeats`` numbers
    return df.join(folds, F.col(key) == F.col("_key")).drop("_key")


def repeated_stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, repeats: int = 10,
                              seed: int = 42) -> DataFrame:
    """``repeated_folds`` in long form: (row, repeat, fold)."""
    folds = repeated_folds(df, label, key, k, repeats, seed, "_folds")
    return folds.select(*df.columns, F.posexplode("_folds").alias("repeat", "fold"))


def bootstrap_draw(df: DataFrame, key: str, size: int = 300, seed: int = 42) -> DataFrame:
    """``size`` rows drawn with replacement: draw i takes the row at position
    hash(i|seed) mod n in md5(key|seed) order. Output adds ``draw``.

    The table is counted by hash bucket (at most 65,536 counts, map-side
    combined); the counts tell in which buckets the positions lie and at which
    rank there. Only rows of those buckets are read on and numbered: ``size``
    buckets at most, each 1/65,536 of the table."""
    spark = df.sparkSession
    h = df.withColumn("_h", key_hash(key, seed)).withColumn("_b", hash_bucket("_h"))
    counts = sorted((r["_b"] or "", r["_b"], r["n"]) for r in h.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, _, c in counts)
    ends = list(accumulate(c for _, _, c in counts))
    places = []
    for r in spark.range(size).select("id", hash_int(F.col("id"), seed).alias("v")).collect() if n else ():
        at = r["v"] % n
        i = bisect_right(ends, at)
        places.append((r["id"], counts[i][1], at - (ends[i] - counts[i][2])))
    draws = spark.createDataFrame(places, "draw long, _b string, _at long")
    hit = h.join(F.broadcast(draws.select("_b").distinct()), "_b", "left_semi")
    numbered = hit.withColumn("_at", F.row_number().over(Window.partitionBy("_b").orderBy("_h")).cast("long") - 1)
    return numbered.join(F.broadcast(draws), ["_b", "_at"]).select(*df.columns, "draw")
