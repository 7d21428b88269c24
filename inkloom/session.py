"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Splits from which on a table is never spread over more tasks.
FEW = 64


def session(app: str = "inkloom", cores: str = "*", **settings: str) -> SparkSession:
    """A session with the settings the operators expect; on a cluster the
    submitting side's settings win."""
    b = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER_SET"):
        b = b.master(f"local[{cores}]")
    known = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (known | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, spark.checkpoint.dir.  Where it is unset a
    local session (tests) gets a temporary folder; on a cluster, whose machines do
    not share one, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        at = "file://" + os.path.join(tempfile.gettempdir(), "inkloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores where it is read in a handful of
    splits, fewer than FEW: for heavy work on small tables.  A table of more splits
    is left as it is read, so a large one is never shuffled for this."""
    cores = min(df.sparkSession.sparkContext.defaultParallelism, FEW)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_again(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, the outcome of a shuffle of the scanned table ``source``, over as many tasks
    as there are cores where ``source`` is read in a handful of splits: adaptive
    execution would put a small table's rows into one task, however much work follows."""
    cores = min(df.sparkSession.sparkContext.defaultParallelism, FEW)
    return df.repartition(cores) if source.rdd.getNumPartitions() <= cores else df
