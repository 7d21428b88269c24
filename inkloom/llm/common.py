"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Splits from which on a table is never spread over more tasks.
FEW = 64


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir.  Where it is unset a local
    session (tests) gets a temporary folder, made its checkpoint folder; on a cluster
    that is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        set_dir = "file://" + os.path.join(tempfile.gettempdir(), "inkloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once in the shared folder and read again: cuts
    lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def bounded_sample(df: DataFrame, key: str, size: int, salt: str = "sample") -> DataFrame:
    """At most ``size`` rows, those of least hash of ``key``.  Only about twice as
    many rows as asked for pass the hash's threshold, so no task sends more."""
    total = df.count()
    if total > 2 * size:
        df = df.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 31)) < int((1 << 31) * (2.0 * size + 200) / total))
    return df.orderBy(F.xxhash64(F.lit(salt), F.col(key)), key).limit(size)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, pruned to ``columns``; over as many tasks as there are cores
    where its texts are read in a handful of splits, fewer than FEW: a large table is
    never shuffled for this."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = min(spark.sparkContext.defaultParallelism, FEW)
    heavy = {"text", "body", "content", "vs_emb"} & set(df.columns)
    return df.repartition(cores) if heavy and df.rdd.getNumPartitions() < cores else df
