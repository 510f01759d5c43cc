"""Cutting lineage in loops over frames."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master, one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a written table, whose size Spark reads anew, so that estimates do not multiply
    from round to round of a loop of joins as they do over checkpoints."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
