"""Retention of stored tables: whole partitions go by their name, only the partition at the edge is read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from costloom.functions.tables import durable


def partitions(spark: SparkSession, path: str, partition: str) -> dict[str, str]:
    """(value, path) of the partitions of a table, from the folder's listing alone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}=*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return {f.getPath().getName().split("=", 1)[1]: f.getPath().toString() for f in found}


def drop_before(spark: SparkSession, path: str, partition: str, column: str, cutoff: dt.datetime) -> dict[str, list[str]]:
    """Remove the rows of the table at ``path`` whose ``column`` lies before ``cutoff``.

    The table is partitioned by ``partition``, the day of ``column``. Days before the cutoff's go as folders,
    unread; the cutoff's own day is filtered and rewritten, unless it begins the day; later days, and rows without a
    day, stay as they are, file by file. Returns the days that went and that were rewritten. Run again, it changes nothing more.
    """
    held, edge = partitions(spark, path, partition), cutoff.date().isoformat()
    gone = sorted(d for d in held if d < edge and d[:1].isdigit())
    rewritten: list[str] = []
    if edge in held and cutoff.time() != dt.time():
        rows = spark.read.parquet(path).where((F.col(partition) == F.lit(cutoff.date())) & (F.col(column) >= F.lit(cutoff)))
        kept = durable(rows, "edge")
        if kept.isEmpty():
            gone.append(edge)
        else:
            kept.write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
            rewritten.append(edge)
    for day in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held[day])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return {"gone": gone, "rewritten": rewritten}
