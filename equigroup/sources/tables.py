"""Reading the input tables. Parquet by default; any Spark format works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, fmt: str = "parquet",
               options: dict | None = None) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.{fmt}" if fmt == "parquet" else f"{sf_dir.rstrip('/')}/{name}"
    return spark.read.format(fmt).options(**(options or {})).load(path)


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
