"""Test cohorts over the given tables (FIXTURES.md B). Each is a lazy plan:
projections reach the parquet scan, joins are left to Catalyst/AQE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equigroup.functions.hashing import key_hash
from equigroup.sources.tables import read_table

EMB_DIM = 64


def c_ord(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                               "o_orderpriority", "o_orderstatus")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .select("o_orderkey", "o_totalprice", "c_acctbal", "n_regionkey", "c_mktsegment",
                     "o_orderpriority", "o_orderstatus"))


def c_na(spark: SparkSession, sf: str) -> DataFrame:
    d = c_ord(spark, sf)
    return d.select(
        "o_orderkey", "o_totalprice",
        F.when(key_hash("o_orderkey", "na1") < F.lit("0d"), F.lit(None).cast("double"))
         .otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "n_regionkey",
        F.when(key_hash("o_orderkey", "na2") < F.lit("1a"), F.lit(None).cast("string"))
         .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        "o_orderpriority", "o_orderstatus")


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus"]
LINE_TARGET = "l_returnflag"


def c_line(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(*LINE_FEATURES, LINE_TARGET)


def all_doc(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


def c_doc(spark: SparkSession, sf: str) -> DataFrame:
    lab = read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    doc = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(doc, "doc_id").select("doc_id", "lang", "source", "n_chars", "toxic", "quality")


def c_pred(spark: SparkSession, sf: str) -> DataFrame:
    d = c_doc(spark, sf)
    return d.select(
        "doc_id", "lang", F.col("quality").alias("y_true"),
        F.when(F.col("n_chars") > 1500, F.lit(1)).otherwise(F.lit(0)).alias("y_pred"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n_chars") - 1500) / F.lit(1000.0)))).alias("p1"))


def c_pred3(spark: SparkSession, sf: str) -> DataFrame:
    d = c_ord(spark, sf)
    return d.select(
        "o_orderkey", "c_mktsegment",
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
         .otherwise(2).alias("y_true"),
        F.when(F.col("o_totalprice") < 150000, 0).when(F.col("o_totalprice") < 300000, 1)
         .otherwise(2).alias("y_pred"))


EMB_FEATURES = [f"f{i}" for i in range(EMB_DIM)]


def c_emb(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.selectExpr("vec_id", *[f"cast(embedding[{i}] as double) as f{i}" for i in range(EMB_DIM)], "label")


def c_emb_binned(spark: SparkSession, sf: str, scale: float = 10.0) -> DataFrame:
    """C_emb with equal-width integer codes ``floor(x * scale)`` (Q5: raw
    continuous values make every plug-in entropy degenerate)."""
    e = c_emb(spark, sf)
    return e.selectExpr("vec_id", *[f"cast(floor({c} * {scale}D) as bigint) as {c}" for c in EMB_FEATURES], "label")


def c_run(spark: SparkSession, sf: str) -> DataFrame:
    """Run log with file names (one rejected dataset name, zero and null values).
    Precision and F1 columns are derived the same deterministic way as acc."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    ds = (F.when(F.col("o_orderkey") % 5 == 0, "Diabetes").when(F.col("o_orderkey") % 5 == 1, "Heart_disease")
           .when(F.col("o_orderkey") % 5 == 2, "Breast_cancer").when(F.col("o_orderkey") % 5 == 3, "Obesity")
           .otherwise("Unknown"))
    m = (F.when(F.col("o_custkey") % 5 == 0, "XGBoost").when(F.col("o_custkey") % 5 == 1, "SVM")
          .when(F.col("o_custkey") % 5 == 2, "MLP").when(F.col("o_custkey") % 5 == 3, "RandomForest")
          .otherwise("LogisticRegression"))
    g = (F.when(F.col("o_orderpriority") == "1-URGENT", "ungrouped")
          .when(F.col("o_orderpriority") == "2-HIGH", "random")
          .when(F.col("o_orderpriority") == "3-MEDIUM", "group_dissimilar")
          .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "kplus").otherwise("bicriterion"))
    r = F.col("o_orderkey") % 10
    acc = (F.when(F.col("o_orderkey") % 17 == 0, F.lit(0.0))
            .when(F.col("o_orderkey") % 19 == 0, F.lit(None).cast("double"))
            .otherwise(F.col("o_totalprice")))
    prec = (F.col("o_custkey") % 97).cast("double") / F.lit(100.0)
    f1 = (F.col("o_orderkey") % 89).cast("double") / F.lit(100.0)
    fname = F.concat(F.when(g == "ungrouped", F.lit("performance_metrics_Ungrouped_"))
                      .otherwise(F.lit("performance_metrics_Grouped_")),
                     ds, F.lit("_"), m, F.lit("_"), g, F.lit("_run"), r.cast("string"), F.lit(".json"))
    return o.select(fname.alias("file_name"), acc.alias("acc"), prec.alias("prec"), f1.alias("f1"))


def c_fair_run(spark: SparkSession, sf: str) -> DataFrame:
    """Fairness run log: file names over every grouping token (incl. ungrouped)
    and six metrics with NaN, zero, tiny (< 1e-8) and null values."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    ds = (F.when(F.col("o_orderkey") % 5 == 0, "Diabetes").when(F.col("o_orderkey") % 5 == 1, "Heart_disease")
           .when(F.col("o_orderkey") % 5 == 2, "Breast_cancer").when(F.col("o_orderkey") % 5 == 3, "Obesity")
           .otherwise("Unknown"))
    m = (F.when(F.col("o_custkey") % 5 == 0, "XGBoost").when(F.col("o_custkey") % 5 == 1, "SVM")
          .when(F.col("o_custkey") % 5 == 2, "MLP").when(F.col("o_custkey") % 5 == 3, "RandomForest")
          .otherwise("LogisticRegression"))
    g = (F.when(F.col("o_orderpriority") == "1-URGENT", "ungrouped")
          .when(F.col("o_orderpriority") == "2-HIGH", "random")
          .when(F.col("o_orderpriority") == "3-MEDIUM", "group_dissimilar")
          .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "kplus").otherwise("bicriterion"))
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    fname = F.concat(F.lit("fairness_metrics_"), ds, F.lit("_"), m, F.lit("_"), g, F.lit("_run"),
                     (k % 10).cast("string"), F.lit(".json"))
    return o.select(
        fname.alias("file_name"),
        F.when(k % 23 == 0, F.lit(float("nan"))).when(k % 29 == 0, F.lit(0.0)).otherwise(p / 300000.0)
         .alias("Disparate Impact"),
        ((c % 50).cast("double") / 100.0).alias("Equal Opportunity"),
        F.when(k % 31 == 0, F.lit(1e-9)).otherwise((k % 37).cast("double") / 100.0).alias("Equalized Odds"),
        ((c % 41).cast("double") / 50.0).alias("Predictive Parity"),
        (p / 100000.0).alias("N-Sigma (ErrorRate)"),
        F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise((k % 11).cast("double") / 20.0)
         .alias("Average distance from origin"))
