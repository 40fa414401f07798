"""Run-log sources and sinks (S2-S7): per-run metric JSON files, benchmark
CSV, CSV / JSON writers. Reading is one distributed scan with
``recursiveFileLookup`` + ``pathGlobFilter``; one row per file (whole text),
parsed with ``from_json`` so unreadable files become NULL and are counted."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equigroup.vocab import DATASETS, FAIRNESS_KEYS, GROUPINGS, MODELS

PERF_SCHEMA = ("array<struct<Model:string, Accuracy:double, Precision:double, "
               "`F1-score`:double, `ROC AUC`:double>>")
FAIR_SCHEMA = "struct<" + ", ".join(f"`{k}`:double" for k in FAIRNESS_KEYS) + ">"


def _alt(tokens) -> str:
    return "|".join(sorted(tokens, key=len, reverse=True))


def _vocab(mapping: dict) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def _dataset(part: Column) -> Column:
    key = F.lower(part)
    fallback = F.regexp_replace(F.regexp_replace(key, "__", "_"), "^_+|_+$", "")
    vocab = _vocab(DATASETS)
    return F.coalesce(vocab[key], vocab[fallback])


# One anchored pattern per file kind: the prefix is case-sensitive, the model
# and grouping tokens are not; ``_run(?!.*_run)`` is the LAST ``_run``, and the
# greedy dataset part makes the tokens match from the right.
PERF_RE = (rf"^performance_metrics_(Grouped|Ungrouped)_(.*)_(?i:({_alt(MODELS)}))_(?i:({_alt(GROUPINGS)}))"
           r"_run(?!.*_run).*\.json$")
FAIR_RE = (rf"^fairness_metrics_()(.*)_(?i:({_alt(MODELS)}))_(?i:({_alt(GROUPINGS)}))"
           r"_run(?!.*_run).*\.json$")


SEP = "\u0001"


def _parse(df: DataFrame, name: str, rx: str, kind_rule) -> DataFrame:
    # one regex pass per row: a match is rewritten to SEP kind SEP ds SEP model
    # SEP grouping; a name that does not match stays as it is (no leading SEP)
    rewritten = F.regexp_replace(F.col(name), rx, SEP + "$1" + SEP + "$2" + SEP + "$3" + SEP + "$4")
    parts = F.when(F.startswith(rewritten, F.lit(SEP)), F.split(rewritten, SEP))
    # a one-element explode is an evaluation barrier: its output is computed
    # once per row and never inlined into the four uses (or a pushed filter)
    x = df.select("*", F.explode(F.array(parts)).alias("_p")).select(
        *df.columns, F.col("_p")[1].alias("_kind"), F.lower(F.col("_p")[2]).alias("_ds"),
        F.lower(F.col("_p")[3]).alias("_mt"), F.lower(F.col("_p")[4]).alias("_gt"))
    ds = _dataset(F.col("_ds"))
    ok = F.coalesce(F.col("_gt") != "", F.lit(False)) & kind_rule(F.col("_kind"), F.col("_gt")) & ds.isNotNull()
    return x.select(*df.columns, F.when(ok, ds).alias("dataset"),
                    F.when(ok, _vocab(MODELS)[F.col("_mt")]).alias("model"),
                    F.when(ok, _vocab(GROUPINGS)[F.col("_gt")]).alias("grouping"))


def parse_performance_names(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Add (dataset, model, grouping) parsed from performance run file names
    ``performance_metrics_{Grouped|Ungrouped}_{dataset}_{model}_{grouping}_
    run{n}.json``: tokens matched from the right, case-insensitively, on the
    part before the last ``_run``; a Grouped name may not carry the ungrouped
    token and an Ungrouped name must; NULLs when the name is rejected."""
    return _parse(df, name, PERF_RE,
                  lambda kind, g: F.when(kind == "Grouped", g != "ungrouped").otherwise(g == "ungrouped"))


def parse_fairness_names(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Add (dataset, model, grouping) parsed from ``fairness_metrics_{dataset}_
    {model}_{grouping}_run{n}.json`` (any grouping token incl. ungrouped)."""
    return _parse(df, name, FAIR_RE, lambda kind, g: F.lit(True))


def read_run_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, file_name, text): one row per file under ``root`` whose name
    matches the glob ``pattern``, at any depth."""
    # wholetext must go through text(): it resets the option to its keyword default
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
                     F.col("value").alias("text"))


def save_run_folders(runs: DataFrame, root: str) -> None:
    """Write (file_name, text) as one folder a run, ``file_name=<name>``, the
    way Spark writes a tree of runs."""
    runs.select("file_name", F.col("text").alias("value")).repartition("file_name") \
        .write.mode("append").partitionBy("file_name").text(root)


def read_run_folders(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(file_name, text) of the runs that ``save_run_folders`` wrote and whose
    name matches the glob ``pattern``."""
    df = spark.read.schema("value string, file_name string").text(root, wholetext=True)
    return df.where(F.col("file_name").rlike("^" + fnmatch.translate(pattern).replace(r"\z", r"\Z"))) \
        .select("file_name", F.rtrim("value").alias("text"))


def performance_records(files: DataFrame) -> DataFrame:
    """(file_name, ok, dataset, grouping, model, Accuracy, Precision, F1-score):
    the first object of each file's JSON array; ``ok`` is false for names that
    do not parse or contents that are not a non-empty array."""
    x = parse_performance_names(files.select("file_name", "text"))
    x = x.withColumn("_arr", F.from_json(F.col("text"), PERF_SCHEMA))
    x = x.withColumn("_r", F.when(F.size("_arr") > 0, F.element_at("_arr", 1)))
    return x.select("file_name", (F.col("dataset").isNotNull() & F.col("_r").isNotNull()).alias("ok"),
                    "dataset", "grouping", "model",
                    F.col("_r.Accuracy").alias("Accuracy"), F.col("_r.Precision").alias("Precision"),
                    F.col("_r.`F1-score`").alias("F1-score"))


def fairness_records(files: DataFrame) -> DataFrame:
    x = parse_fairness_names(files.select("file_name", "text"))
    x = x.withColumn("_r", F.from_json(F.col("text"), FAIR_SCHEMA, {"allowNonNumericNumbers": "true"}))
    return x.select("file_name", (F.col("dataset").isNotNull() & F.col("_r").isNotNull()).alias("ok"),
                    "dataset", "grouping", "model", *[F.col("_r").getField(k).alias(k) for k in FAIRNESS_KEYS])


def skipped_count(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(~F.col("ok")).cast("bigint").alias("skipped"),
                       F.count_if(F.col("ok")).cast("bigint").alias("parsed"))


def load_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """(model, min, mean, max) in percent; columns resolved by case-insensitive
    substring ('model', 'min', 'mean', 'max'); error if one is missing."""
    df = spark.read.option("header", True).csv(path)

    kinds = {"model": "string", "min": "double", "mean": "double", "max": "double"}
    found = {want: [c for c in df.columns if want in c.lower()][:1] for want in kinds}
    if lacking := sorted(want for want, hit in found.items() if not hit):
        raise ValueError(f"{path}: no column named like {', '.join(lacking)}")
    return df.select(*[F.col(f"`{hit[0]}`").cast(kinds[want]).alias(want) for want, hit in found.items()])


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def save_metrics(df: DataFrame, path: str, run_id: int | None = None, mode: str = "append") -> None:
    """Append metric rows to a JSON table, partitioned by ``run_id`` when given."""
    if run_id is not None:
        df.withColumn("run_id", F.lit(int(run_id))).write.mode(mode).partitionBy("run_id").json(path)
    else:
        df.write.mode(mode).json(path)
