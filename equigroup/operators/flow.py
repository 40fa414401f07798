"""The whole preparation flow (E10): clean, draw the test set from clean rows,
train = raw minus test, fit encoders and moments on train, apply to both.
Returns lazy (train, test) plans; fitted state is bounded by the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.operators import prep, split
from equigroup.session import materialize as _materialize
from equigroup.spec import CohortSpec


def prepare(raw: DataFrame, spec: CohortSpec, normalise: bool = True, encode: bool = True,
            base_fraction: float = 0.2, seed: int = 42, materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """With ``materialize`` the drawn test set and the cleaned training rows
    are checkpointed (reliably, to ``spark.checkpoint.dir``) so the fits that
    follow do not re-run the draw, and lost executors do not either."""
    raw = raw.drop(*spec.drop)
    clean = prep.drop_null_rows(raw)
    test = split.draw_test_from_clean(raw, clean, spec.key, base_fraction, seed)
    if materialize:
        test = _materialize(test)
    train = prep.drop_null_rows(split.train_minus_test(raw, test, spec.key))
    if materialize:
        train = _materialize(train)
    if encode:
        fitted = prep.fit_encoding(train, spec)
        train = prep.encode_cohort(train, spec, fitted)
        test = prep.encode_cohort(test, spec, fitted)
    if normalise:
        cols = [c for c in spec.numeric if c in train.columns] + \
               [c for c in spec.ordinal if c in train.columns]
        moments = prep.fit_moments(train, cols)
        train = prep.apply_zscore(train, cols, moments)
        test = prep.apply_zscore(test, cols, moments)
    return prep.target_last(train, spec.target), prep.target_last(test, spec.target)


def split_summary(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Per split: row count and the sum of every non-key numeric column."""
    cols = [c for c in train.columns if c != key]

    def one(df, name):
        return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                      *[F.sum(F.col(f"`{c}`").cast("double")).alias(f"sum_{c}") for c in cols]) \
                 .select(F.lit(name).alias("split"), "*")
    return one(train, "train").unionByName(one(test, "test"))
