"""Months, day spines, period alignment and ISO periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_window(day: dt.date) -> tuple[dt.date, dt.date]:
    """The month of a day as [first, first of the next)."""
    first = day.replace(day=1)
    return first, (first + dt.timedelta(days=32)).replace(day=1)


def day_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day of [start, end)."""
    days = (end - start).days
    return spark.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))


def gap_filled(keys: DataFrame, values: DataFrame, on: list[str], start: dt.date, end: dt.date, value: str) -> DataFrame:
    """Every key on every day of [start, end), with 0 where ``values`` has no row.

    The days are an array on each key, so there is no join against a day table.
    """
    days = F.sequence(F.lit(start), F.lit(end - dt.timedelta(days=1)))
    grid = keys.select(*on, F.explode(days).alias("date"))
    return grid.join(values, [*on, "date"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def align(ts: Column, seconds: Column | int) -> Column:
    """A timestamp floored to a period in seconds."""
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def iso_period_minutes(period: Column) -> Column:
    """Minutes of an ISO period such as PT5M, PT1H or P1D; 5 for anything else."""
    number = F.regexp_extract(period, "^PT?(\\d+)[MHD]$", 1).try_cast("int")
    unit = F.regexp_extract(period, "([MHD])$", 1)
    known = F.when(unit == "M", number).when(unit == "H", number * 60).when(unit == "D", number * 1440)
    return F.coalesce(known, F.lit(5))
