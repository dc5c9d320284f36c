"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits by quantiles of its values, in their own order (text by
its first bytes), so a shard's minimum and maximum of each dimension prune it for most predicates.
Rows are ordered by their cell's index on the Hilbert curve, inside a cell by a hash of their group
(equal texts, say), and the order is cut into runs whose row counts differ by at most one. All rows
of a group take the cell of its least row, so they stand together.

The order is Spark's own range partitioning with sorted partitions. A row's exact position is the
number of rows in the partitions before its own plus its place in it: no window holds more than one
row a partition. The last sort keys are hashes of the row's key and a random salt, so neither a cell
nor a group nor a key that holds a third of all rows lies in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from costloom.llm.common import durable


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with ``bits``-bit coordinates, after Skilling (2004)."""
    x = [a.astype(np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the top bit down
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x = [a ^ flip for a in x]
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = index << 1 | (a >> b & 1)
    return index


def ordinal(column: Column, numeric: bool) -> Column:
    """A number in the order of a column's values; of text, its first seven bytes count."""
    if numeric:
        return column.cast("double")
    first = F.substring(column.cast("string").cast("binary"), 1, 7)
    return F.conv(F.rpad(F.hex(first), 14, "0"), 16, 10).cast("double")


def quantiles(rows: DataFrame, dimensions: dict[str, bool], bits: int) -> dict[str, list[float]]:
    """At most ``2 ** bits - 2`` distinct cut points of each dimension, in one aggregation."""
    shares = [k / ((1 << bits) - 1) for k in range(1, (1 << bits) - 1)]
    found = rows.agg(*[F.percentile_approx(ordinal(F.col(c), numeric), shares, 10_000).alias(c) for c, numeric in dimensions.items()]).first()
    return {c: sorted(set(found[c] or [])) for c in dimensions}


def quantised(value: Column, cuts: list[float]) -> Column:
    """1 plus the number of cut points up to a value; 0 for null."""
    above = F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>"), lambda x: x <= value))
    return F.when(value.isNull(), 0).otherwise(above + 1).cast("int")


def shard_by_hilbert(
    rows: DataFrame,
    key: str,
    dimensions: dict[str, bool],
    shards: int = 8,
    bits: int = 5,
    group: str | None = None,
) -> DataFrame:
    """``rows`` with ``curve_index``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``dimensions`` maps column names to whether they are numeric. Rows with equal values of ``group``
    (a column; null: no group) stand together, so at most shards - 1 groups are cut, besides those
    larger than a shard. ``rows`` should be narrow: it is written twice and shuffled once; join wide
    columns back by key. Null dimensions come first, null keys too; ties and repeated rows get
    positions of their own, in no fixed order among fully equal rows. Columns named curve_index, shard
    or slot are replaced. An empty table gives an empty result. Shard sizes differ by at most one row.
    """

    @F.pandas_udf("long")
    def curve(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    names = [c for c in rows.columns if c not in ("curve_index", "shard", "slot")]
    own = F.xxhash64(F.col(group)) if group else F.xxhash64(F.lit(7), F.col(key))
    if group:
        own = F.when(F.col(group).isNull(), F.xxhash64(F.lit(7), F.col(key))).otherwise(own)
    stored = durable(rows.select(*names, own.alias("__group"), F.rand(7).alias("__salt")), "hilbert-rows")
    cuts = quantiles(stored, dimensions, bits)
    cells = F.struct(*[quantised(ordinal(F.col(c), numeric), cuts[c]).alias(f"d{k}") for k, (c, numeric) in enumerate(dimensions.items())])
    celled = stored.withColumn("__cell", cells)
    if group:
        # only groups that lie in several cells need one chosen
        least = celled.groupBy("__group").agg(F.min("__cell").alias("__least"), F.max("__cell").alias("__most")).where("__least <> __most").select("__group", "__least")
        # such a group may hold a third of all rows, so its rows are dealt over pieces
        pieces = least.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.lit(31))))
        celled = celled.withColumn("__piece", F.floor(F.col("__salt") * 32).cast("int")).join(pieces, ["__group", "__piece"], "left").withColumn("__cell", F.coalesce("__least", "__cell")).drop("__least", "__piece")
    placed = celled.withColumn("curve_index", curve(*[F.col(f"__cell.d{k}") for k in range(len(dimensions))])).withColumn("__key", F.xxhash64(F.col(key)))
    ordered = placed.repartitionByRange("curve_index", "__group", "__key", "__salt").sortWithinPartitions("curve_index", "__group", F.col(key), "__salt")
    # a partition's number in the upper bits, the place in it in the lower 33
    numbered = durable(ordered.select(*names, "curve_index", F.monotonically_increasing_id().alias("__at")), "hilbert")
    parts = numbered.groupBy(F.shiftrightunsigned("__at", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    # one row a partition
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(W.partitionBy()).alias("__count"))
    ranked = numbered.withColumn("__part", F.shiftrightunsigned("__at", 33)).join(F.broadcast(starts), "__part")
    position, small, extra = F.col("__at") + F.col("__shift"), F.floor(F.col("__count") / shards), F.col("__count") % shards
    # the first `extra` shards hold one row more
    edge = extra * (small + 1)
    shard = F.when(position < edge, F.floor(position / (small + 1))).otherwise(extra + F.floor((position - edge) / F.greatest(small, F.lit(1)))).cast("int")
    start = F.col("shard") * small + F.least(F.col("shard").cast("long"), extra)
    return ranked.withColumn("shard", shard).withColumn("slot", (position - start).cast("long")).select(*names, "curve_index", "shard", "slot")


def pruning_index(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """Row count, minimum and maximum of each dimension per shard: what a reader prunes files by."""
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in dimensions for f in (F.min, F.max)]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *bounds)


def write_shards(sharded: DataFrame, path: str, dimensions: list[str]) -> DataFrame:
    """Write one folder a shard under ``path``, rows by slot, and the pruning index beside them; returns the index.

    A shard may be several files, each a run of its slots, so files prune by row-group statistics too.
    """
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/shards")
    pruning_index(sharded, dimensions).write.parquet(f"{path}/index")
    return sharded.sparkSession.read.parquet(f"{path}/index")


def read_pruned(spark: SparkSession, path: str, column: str, low, high) -> DataFrame:
    """The rows with ``low <= column <= high``, from the shards whose bounds meet that interval only.

    The index has one row a shard, so the shards to read are picked on the driver.
    """
    index = spark.read.parquet(f"{path}/index").where((F.col(f"min_{column}") <= F.lit(high)) & (F.col(f"max_{column}") >= F.lit(low)))
    shards = [r["shard"] for r in index.select("shard").collect()]
    rows = spark.read.parquet(f"{path}/shards")
    return rows.where(F.col("shard").isin(shards) & F.col(column).between(F.lit(low), F.lit(high)))
