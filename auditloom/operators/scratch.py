"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="auditloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir, which the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):  # one machine, as in tests
        folder = _local_folder()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df, cut off from its lineage by a reliable checkpoint in the folder spark.checkpoint.dir."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
