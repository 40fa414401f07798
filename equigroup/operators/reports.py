"""Run reporting (inventory 2.13 and the report sinks of 2.1).

Records are (dataset, grouping, model, metric columns...). Reports unpivot
the metrics and pivot datasets into columns over the fixed display order, so
the schema does not depend on the data and no distinct values are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equigroup.functions.columns import usable
from equigroup.operators.metrics import recall_from
from equigroup.vocab import (BENCH_GROUPING_ORDER, BENCH_MODEL_ORDER, BENCHMARK_ACCURACY, DATASETS,
                             ORDERED_DATASETS, ORDERED_GROUPINGS)

REPORT_DATASETS = [d for d in ORDERED_DATASETS if d in DATASETS.values()] + \
    sorted(set(DATASETS.values()) - set(ORDERED_DATASETS))


def with_recall(records: DataFrame) -> DataFrame:
    return records.withColumn("Recall", recall_from(F.col("Precision"), F.col("F1-score")))


def run_counts(records: DataFrame) -> DataFrame:
    """Number of parsed runs per (dataset, grouping), sorted."""
    return records.groupBy("dataset", "grouping").agg(F.count(F.lit(1)).cast("bigint").alias("runs")) \
                  .orderBy("dataset", "grouping")


def display_rank(name: Column, order: list[str]) -> Column:
    """Position in the fixed order, unknown names after it (then by name)."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(m[name], F.lit(len(order)))


def pivot_report(records: DataFrame, metrics: list[str], eps: float = 0.0,
                 datasets: list[str] = REPORT_DATASETS) -> DataFrame:
    """(metric, grouping, <dataset>...): mean over models and runs of the
    usable values (not null/NaN/inf/0, and |v| >= eps when eps > 0)."""
    long = (records.unpivot(["dataset", "grouping"], metrics, "metric", "value")
                   .select("dataset", "grouping", "metric", usable(F.col("value"), eps).alias("uv")))
    return long.groupBy("metric", "grouping").pivot("dataset", datasets).agg(F.avg("uv"))


def report_order(report: DataFrame, metrics: list[str]) -> DataFrame:
    """Adds the display position of each row (metric order, then grouping
    order, unknown groupings alphabetically after the fixed ones)."""
    w = Window.orderBy(display_rank(F.col("metric"), metrics), display_rank(F.col("grouping"), ORDERED_GROUPINGS),
                       F.col("grouping"))
    return report.withColumn("position", F.row_number().over(w).cast("int"))


def file_safe(metric: Column, fairness: bool = False) -> Column:
    """Metric name as used in report file names: spaces -> '_' (performance);
    fairness also maps '-' -> '_' and drops parentheses."""
    out = F.replace(metric, F.lit(" "), F.lit("_"))
    if fairness:
        out = F.regexp_replace(F.replace(out, F.lit("-"), F.lit("_")), "[()]", "")
    return out


def format_report(report: DataFrame, datasets: list[str] = REPORT_DATASETS, fairness: bool = False) -> DataFrame:
    """Cells as text with 6 decimals, missing as '-' (the CSV sink format);
    the metric name made file-safe."""
    cols = [file_safe(F.col("metric"), fairness).alias("metric_file"), "grouping"]
    cols += [F.coalesce(F.format_string("%.6f", F.col(f"`{d}`")), F.lit("-")).alias(d) for d in datasets]
    return report.select(*cols)


def summary_json(report: DataFrame, metrics: list[str], datasets: list[str] = REPORT_DATASETS) -> DataFrame:
    """(metric, json): metric -> grouping -> dataset -> value, missing values
    dropped, in report order (maps keep insertion order)."""
    cells = F.filter(F.array(*[F.struct(F.lit(d).alias("k"), F.col(f"`{d}`").alias("v")) for d in datasets]),
                     lambda s: s["v"].isNotNull())
    per_g = report.select("metric", "grouping",
                          display_rank(F.col("grouping"), ORDERED_GROUPINGS).alias("_r"),
                          F.map_from_entries(cells).alias("m"))
    def by_rank(a, b):
        return (F.when(a["_r"] < b["_r"], -1).when(a["_r"] > b["_r"], 1)
                 .when(a["grouping"] < b["grouping"], -1).when(a["grouping"] > b["grouping"], 1).otherwise(0))
    per_m = per_g.groupBy("metric").agg(
        F.array_sort(F.collect_list(F.struct("_r", "grouping", "m")), by_rank).alias("_l"))
    return per_m.select("metric", F.to_json(F.map_from_entries(
        F.transform("_l", lambda s: F.struct(s["grouping"], s["m"])))).alias("json"),
        display_rank(F.col("metric"), metrics).alias("position"))


def dataset_model_means(records: DataFrame, dataset: str, metric: str) -> DataFrame:
    """One dataset: mean of one metric per (model, grouping) over valid values."""
    return (records.filter(F.col("dataset") == dataset)
                   .groupBy("model", "grouping").agg(F.avg(usable(F.col(metric))).alias("value"))
                   .filter(F.col("value").isNotNull()))


def benchmark_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BENCHMARK_ACCURACY, "model string, min double, mean double, max double")


def benchmark_compare(means: DataFrame, bench: DataFrame) -> DataFrame:
    """Per (model, grouping): value in percent against the benchmark range,
    with the plot padding max(1, 2% of the span of all models)."""
    span = bench.agg((F.max("max") - F.min("min")).alias("span"))  # one row
    j = means.join(bench, "model", "left").crossJoin(F.broadcast(span))
    pct = F.col("value") * 100.0
    return j.select("model", "grouping", pct.alias("value_pct"), "min", "mean", "max",
                    (pct < F.col("min")).alias("below_min"),
                    ((pct >= F.col("min")) & (pct <= F.col("max"))).alias("within"),
                    (pct > F.col("max")).alias("above_max"),
                    F.greatest(F.lit(1.0), F.lit(0.02) * F.col("span")).alias("pad"))


def overlay_long(means: DataFrame) -> DataFrame:
    """Complete (grouping x model) grid in display order, percent rounded to 3,
    missing kept as NULL: (grouping, grouping_pos, model, model_pos, value_pct)."""
    spark = means.sparkSession
    present = means.select("model").distinct()
    models = spark.createDataFrame(list(enumerate(BENCH_MODEL_ORDER)), "model_pos int, model string") \
        .join(present, "model", "left_semi")
    groups = spark.createDataFrame(list(enumerate(BENCH_GROUPING_ORDER)), "grouping_pos int, grouping string")
    grid = groups.crossJoin(F.broadcast(models))
    return (grid.join(means, ["model", "grouping"], "left")
                .select("grouping", "grouping_pos", "model", "model_pos",
                        F.round(F.col("value") * 100.0, 3).alias("value_pct")))


def overlay_arrays(long: DataFrame) -> DataFrame:
    """(grouping, values_pct array in model order, NULLs kept)."""
    return long.groupBy("grouping", "grouping_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("model_pos", "value_pct"))),
                    lambda s: s["value_pct"]).alias("values_pct"))
