"""Cutting lineage in iterations: reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine's own only where none is named and the master is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="ckpt-")  # unset only in tests
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_told(df: DataFrame, *what: Column) -> tuple[DataFrame, dict]:
    """cut(df) and aggregates of it by name, taken as its rows pass: no job of their own."""
    seen = Observation()
    return cut(df.observe(seen, *what)), seen.get


def packed(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: edges take a fraction of a checkpoint's bytes."""
    path = f"{shared_folder(df.sparkSession)}/packed-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed_and_told(df: DataFrame, *what: Column) -> tuple[DataFrame, dict]:
    """packed(df) and aggregates of it by name. A checkpoint hands on the optimiser's guess of its size, and a join multiplies its sides' guesses: over rounds of joins these numbers fill the driver. Files have their own size."""
    seen = Observation()
    return packed(df.observe(seen, *what)), seen.get


def apart(df: DataFrame) -> DataFrame:
    """df as the side of a join that is sorted and merged: sizes of checkpoints are guesses, and a large one that is taken for small would go through the driver."""
    return df.hint("merge")
