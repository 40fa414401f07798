"""Spark session helpers.

The checkpoint folder is read from ``spark.checkpoint.dir``; a cluster names a
shared folder there. Only when it is unset (local tests) do we pick one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "equigroup",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is named, a
    local master gets a folder of its own; any other master is an error, since
    executors don't share the driver's disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="equigroup-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if not type(spark).__module__.startswith("pyspark.sql.connect"):  # a remote server reads the setting itself
        spark.sparkContext.setCheckpointDir(path)
    return path


def num_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def gathered(df):
    """``df`` in two partitions a core at most (16 at least). A task works the
    shuffle's partitions off one after another, so it holds no more than before,
    and small tables don't cost a task for each."""
    return df.coalesce(max(16, 2 * df.sparkSession.sparkContext.defaultParallelism))


def materialize(df):
    """Reliable checkpoint that runs the lineage once: persist, checkpoint
    (written to ``spark.checkpoint.dir``, so it survives lost executors), then
    drop the cache. A bare ``checkpoint()`` computes the plan twice."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
