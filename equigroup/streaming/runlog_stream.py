"""Incremental run reports: the performance report (R2) kept up to date while
run files arrive, as a Structured Streaming aggregation.

Files are read as whole texts from a directory stream, parsed like the batch
path (file name -> dataset / model / grouping; first object of the JSON
array), unpivoted to (metric, grouping, dataset, value) and aggregated with
running sums and counts of the usable values; the mean per cell is their
ratio. State is one row per report cell, bounded by the vocabularies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equigroup.functions.columns import usable
from equigroup.operators.reports import with_recall
from equigroup.sources import runlog
from equigroup.vocab import FAIRNESS_KEYS, PERFORMANCE_KEYS


def stream_performance_records(spark: SparkSession, root: str, pattern: str = "performance_metrics_*.json",
                               max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.format("text").option("wholetext", True)
              .option("pathGlobFilter", pattern))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(root).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return runlog.performance_records(files)


def stream_fairness_records(spark: SparkSession, root: str, pattern: str = "fairness_metrics_*.json",
                            max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.format("text").option("wholetext", True)
              .option("pathGlobFilter", pattern))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(root).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return runlog.fairness_records(files)


def streaming_report(records: DataFrame, metrics: list[str] = PERFORMANCE_KEYS, eps: float = 0.0) -> DataFrame:
    """(metric, grouping, dataset, n, mean) maintained incrementally; recall
    is derived when the records carry precision and F1."""
    good = records.filter(F.col("ok"))
    if "Recall" in metrics and "Recall" not in good.columns:
        good = with_recall(good)
    long = (good.unpivot(["dataset", "grouping"], metrics, "metric", "value")
                .select("metric", "grouping", "dataset", usable(F.col("value"), eps).alias("uv")))
    return long.groupBy("metric", "grouping", "dataset").agg(
        F.count("uv").cast("bigint").alias("n"), F.sum("uv").alias("_s")
    ).select("metric", "grouping", "dataset", "n", F.when(F.col("n") > 0, F.col("_s") / F.col("n")).alias("mean"))


def start_report(spark: SparkSession, root: str, checkpoint: str, query_name: str = "performance_report",
                 sink: str = "memory", kind: str = "performance"):
    """Start the streaming report (complete mode) with its own checkpoint;
    ``kind`` is "performance" or "fairness" (|v| < 1e-8 also dropped)."""
    if kind == "fairness":
        rep = streaming_report(stream_fairness_records(spark, root), FAIRNESS_KEYS, eps=1e-8)
    else:
        rep = streaming_report(stream_performance_records(spark, root))
    return (rep.writeStream.outputMode("complete").format(sink).queryName(query_name)
               .option("checkpointLocation", checkpoint).start())
