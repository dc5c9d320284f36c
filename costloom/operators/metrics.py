"""Metric series, rollups that build on each other, source routing and retention."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400


@dataclasses.dataclass(frozen=True)
class Source:
    """A stored metric table: its granularity and retention in seconds (0: raw; a month has 30 days)."""

    name: str
    granularity: int
    retention: int


#: Raw, hourly and daily metrics (fixed values).
REGISTRY = [Source("metrics", 0, 7 * DAY), Source("metrics_hourly", 3_600, 30 * DAY), Source("metrics_daily", DAY, 730 * DAY)]
#: Retention in days (fixed values).
RETENTION_DAYS = {"metrics": 7, "metrics_hourly": 30, "metrics_daily": 730, "kube_metrics": 180, "costs": 1095}


def metric_source_pick(granularity: int, registry: list[Source] = REGISTRY) -> Source:
    """The coarsest table that is at least as fine as asked for, else the raw one."""
    fine = [s for s in registry if 0 < s.granularity <= granularity]
    return max(fine, key=lambda s: s.granularity, default=next(s for s in registry if not s.granularity))


def telemetry_source_pick(window: int, registry: list[Source] = REGISTRY) -> Source:
    """The finest table that is kept for at least the window, else the one kept longest."""
    long = [s for s in registry if s.retention >= window]
    return min(long, key=lambda s: s.granularity) if long else max(registry, key=lambda s: s.retention)


def check_hierarchy(registry: list[Source]) -> None:
    """Every rollup's interval must be a multiple of its source's."""
    levels = sorted(s.granularity for s in registry if s.granularity)
    for a, b in zip(levels, levels[1:]):
        if b % a:
            raise ValueError(f"{b} s is no multiple of {a} s")


def rollup_first(metrics: DataFrame, interval: str = "1 hour") -> DataFrame:
    """(bucket, entity_id, metric, avg/max/min/sum/count_value) from raw points."""
    per = metrics.groupBy(F.window("ts", interval).alias("w"), "entity_id", "metric")
    out = per.agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.sum("value").alias("sum_value"), F.count("value").alias("count_value"))
    return out.select(F.col("w.start").alias("bucket"), *out.columns[1:])


def rollup_next(rollup: DataFrame, interval: str = "1 day") -> DataFrame:
    """A coarser rollup from a finer one, by its mergeable parts."""
    per = rollup.groupBy(F.window("bucket", interval).alias("w"), "entity_id", "metric")
    total, n = F.sum("sum_value"), F.sum("count_value")
    out = per.agg((total / n).alias("avg_value"), F.max("max_value").alias("max_value"), F.min("min_value").alias("min_value"), total.alias("sum_value"), n.alias("count_value"))
    return out.select(F.col("w.start").alias("bucket"), *out.columns[1:])


def rollup_hierarchy(metrics: DataFrame, registry: list[Source] = REGISTRY) -> dict[str, DataFrame]:
    """All rollups of a registry, each from the one before."""
    check_hierarchy(registry)
    out: dict[str, DataFrame] = {}
    last = None
    for s in sorted((s for s in registry if s.granularity), key=lambda s: s.granularity):
        interval = f"{s.granularity} seconds"
        last = rollup_first(metrics, interval) if last is None else rollup_next(last, interval)
        out[s.name] = last
    return out


def metric_series(metrics: DataFrame, start: dt.datetime, end: dt.datetime, interval: str) -> DataFrame:
    """(entity_id, metric, bucket, statistics) in [start, end); weekly buckets start on Monday."""
    offset = "4 days" if "week" in interval else "0 seconds"
    rows = metrics.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    per = rows.groupBy("entity_id", "metric", F.window("ts", interval, startTime=offset).alias("w"))
    out = per.agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.sum("value").alias("sum_value"), F.count("value").alias("count_value"))
    return out.select("entity_id", "metric", F.col("w.start").alias("bucket"), *out.columns[3:])


def namespace_requests(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """(namespace, hour, value, labels): the sum over series of their hourly means, with labels where there are any."""
    means = samples.groupBy("namespace", "series", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("value"))
    return means.groupBy("namespace", "hour").agg(F.sum("value").alias("value")).join(labels, "namespace", "left")


def retention_trim(df: DataFrame, column: str, name: str, as_of: dt.date) -> DataFrame:
    """Rows that a table's retention still keeps; partition pruning does the rest on a dated table."""
    return df.where(F.col(column) >= F.lit(as_of - dt.timedelta(days=RETENTION_DAYS[name])))
