"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="costloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/costloom/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts its lineage and its plan."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
