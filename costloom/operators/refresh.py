"""Refresh of stored rollups: only the buckets that late points touched are computed again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.functions.tables import durable
from costloom.operators.metrics import rollup_first
from costloom.operators.upsert import upsert_partitions

#: Parts of a rollup's key, with the day that its table is partitioned by.
KEYS = ["day", "bucket", "entity_id", "metric"]
STATISTICS = ["avg_value", "max_value", "min_value", "sum_value", "count_value"]


def bucketed(points: DataFrame, interval: str) -> DataFrame:
    """Points with the start of their bucket and its day."""
    rows = points.withColumn("bucket", F.window("ts", interval)["start"])
    return rows.withColumn("day", F.to_date("bucket"))


def touched_buckets(points: DataFrame, interval: str = "1 hour") -> DataFrame:
    """The (day, bucket, entity_id, metric) that points fall into; points without a time are in none."""
    return bucketed(points.where("ts IS NOT NULL"), interval).select(*KEYS).distinct()


def inside_window(touched: DataFrame, now: dt.datetime, window: dt.timedelta, interval: dt.timedelta) -> DataFrame:
    """Touched buckets that a refresh at ``now`` computes: those begun within ``window``, and closed an interval ago."""
    bucket = F.col("bucket")
    return touched.where((bucket >= F.lit(now - window)) & (bucket <= F.lit(now - 2 * interval)))


def save_rollup(points: DataFrame, path: str, interval: str = "1 hour") -> None:
    """A whole rollup as a table by day."""
    rows = rollup_first(points, interval).withColumn("day", F.to_date("bucket"))
    rows.hint("rebalance", F.col("day")).write.partitionBy("day").parquet(path)


def refresh_rollup(points: DataFrame, path: str, touched: DataFrame, interval: str = "1 hour") -> None:
    """Compute the touched buckets of the rollup at ``path`` again from all their points.

    Of ``points`` only the touched buckets' are read (if they are stored by ``day``, only these days' files);
    of the rollup only the touched days are rewritten, and other buckets in them stay as they are. Run again,
    it gives the same table. With nothing touched the table isn't written.
    """
    touched = durable(touched, "touched")
    if touched.isEmpty():
        return
    rows = points
    if "day" in points.columns:
        # a bucket may begin the day before its points where intervals don't divide a day
        near = touched.select(F.explode(F.array("day", F.date_add("day", 1))).alias("day")).distinct()
        rows = points.join(F.broadcast(near), "day", "left_semi") if near.count() <= 4096 else points.join(near, "day", "left_semi")
    rows = bucketed(rows.drop("day"), interval).join(touched, KEYS, "left_semi")
    fresh = rollup_first(rows, interval).withColumn("day", F.to_date("bucket"))
    upsert_partitions(path, fresh.select(*KEYS, *STATISTICS), KEYS, dict.fromkeys(STATISTICS, "replace"), "day")
