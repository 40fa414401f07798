"""Classifier-based imputation of nominal columns (E8) and the imputation
policy (E9): a random forest trained on the rows where the column is known
predicts it where it is missing; labels are written back as labels."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equigroup.session import materialize


def impute_with_classifier(df: DataFrame, column: str, predictors: list[str], seed: int = 42,
                           num_trees: int = 100) -> DataFrame:
    """Fill NULLs of a nominal ``column`` from ``predictors`` (numeric, or
    text of few values, which is indexed); rows whose predictors are NULL too get the most frequent label. Adds
    ``imputed``."""
    known = df.filter(F.col(column).isNotNull())
    missing = df.filter(F.col(column).isNull())
    pred_ok = F.lit(True)
    for c in predictors:
        pred_ok = pred_ok & F.col(c).isNotNull()
    idx = StringIndexer(inputCol=column, outputCol="_y", handleInvalid="keep")
    texts = [c for c in predictors if isinstance(df.schema[c].dataType, T.StringType)]
    coded = [StringIndexer(inputCol=c, outputCol=f"_{c}_code", handleInvalid="keep") for c in texts]
    asm = VectorAssembler(inputCols=[f"_{c}_code" if c in texts else c for c in predictors], outputCol="_x", handleInvalid="error")
    rf = RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_pred", numTrees=num_trees,
                                seed=seed, probabilityCol="_prob", rawPredictionCol="_raw")
    model = Pipeline(stages=[idx, *coded, asm, rf]).fit(known.filter(pred_ok))
    back = IndexToString(inputCol="_pred", outputCol="_label", labels=model.stages[0].labels)
    filled = back.transform(model.transform(missing.filter(pred_ok)))
    filled = filled.select(*[F.col("_label").alias(c) if c == column else F.col(c) for c in df.columns])
    mode = (known.groupBy(column).count().orderBy(F.desc("count"), column).limit(1)
                 .select(F.col(column).alias("_mode")))
    rest = missing.filter(~pred_ok).crossJoin(F.broadcast(mode)).select(
        *[F.col("_mode").alias(c) if c == column else F.col(c) for c in df.columns])
    return (known.withColumn("imputed", F.lit(False))
            .unionByName(filled.withColumn("imputed", F.lit(True)))
            .unionByName(rest.withColumn("imputed", F.lit(True))))


def imputation_policy(df: DataFrame, drop: list[str], impute: list[tuple[str, list[str]]],
                      seed: int = 42) -> DataFrame:
    """Drop columns, impute each listed column in sequence (each sees the
    earlier results; lineage cut by a reliable checkpoint between steps), then
    drop rows with any remaining NULL."""
    cur = df.drop(*drop)
    for column, predictors in impute:
        cur = materialize(impute_with_classifier(cur, column, predictors, seed).drop("imputed"))
    return cur.na.drop("any")
