"""Idempotent upserts as snapshot rewrites: one operator, a policy per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.functions.tables import durable
from costloom.functions.tags import tags_merge


def latest(source: DataFrame, keys: list[str], order: str | Column, first: bool = False) -> DataFrame:
    """One row per key: the one with the largest (or smallest) order value, then the largest row."""
    order = F.col(order) if isinstance(order, str) else order
    rest = [c for c in source.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    # maps can't be ordered; ties fall to the other columns
    ties = [F.col(c) for c, t in source.dtypes if c in rest and not t.startswith("map")]
    return source.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(order, *ties)).alias("__row")).select(*keys, "__row.*")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], policy: dict[str, str], only_if: Column | None = None) -> DataFrame:
    """A new snapshot of ``target`` after ``source`` (unique by key) is applied.

    ``policy`` says what happens to each column of a row that is in both: ``replace``, ``keep``,
    ``merge`` (tag maps, right over left), ``fill`` (only if the old value is null) or ``nonzero``
    (unless the new value is null or 0). Columns without a policy are kept. ``only_if`` is a condition over ``old`` and ``new`` structs under
    which a row changes at all. Columns that the source lacks are null in new rows.
    """
    rest = [c for c in target.columns if c not in keys]
    have = [c for c in rest if c in source.columns]
    kinds = dict(target.dtypes)
    old = target.select(*keys, F.struct(*rest).alias("old"))
    new = source.select(*keys, F.struct(*[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in rest]).alias("new"))
    both = old.join(new, keys, "full")
    changes = F.col("old").isNotNull() & F.col("new").isNotNull()
    if only_if is not None:
        changes = changes & only_if

    def value(c: str) -> Column:
        o, n = F.col(f"old.{c}"), F.col(f"new.{c}")
        how = policy.get(c, "keep") if c in have else "keep"
        after = {"replace": lambda: n, "keep": lambda: o, "merge": lambda: tags_merge(o, n), "fill": lambda: F.coalesce(o, n), "nonzero": lambda: F.when(n != 0, n).otherwise(o)}[how]()
        return F.when(F.col("old").isNull(), n).when(changes, after).otherwise(o).alias(c)

    return both.select(*keys, *[value(c) for c in rest])


#: Policies by table: columns that a newer row changes.
COSTS = {"billed_cost": "replace", "charge_end": "replace"}
METRICS: dict[str, str] = {}
KUBE_METRICS = {"value": "replace", "tags": "replace"}
ENTITY_BASIC = {"parent_id": "nonzero", "type": "replace", "updated_at": "replace"}
ENTITY_COST = {"region": "replace", "tags": "merge", "updated_at": "replace"}
ENTITY_METRIC = {"tags": "replace", "extras": "replace", "meta_hash": "replace", "updated_at": "replace"}
ENTITY_KUBE = {"tags": "merge", "parent_id": "replace", "updated_at": "replace"}
HARDWARE_COMPARED = ["vcpu", "memory_gb", "baseline_iops", "architecture", "is_gpu", "is_confidential", "has_local_storage", "supports_premium"]


def differs(*columns: str) -> Column:
    """Whether any of the columns differs between ``old`` and ``new``; null equals null."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    return out


def billing_hierarchy(rows: DataFrame) -> DataFrame:
    """(external_id, name, type, provider, parent_external_id) of billing accounts and the accounts below them."""
    known = rows.where("provider IN ('aws', 'azure')")
    bills = known.select(F.lower("billing_id").alias("external_id"), F.col("billing_name").alias("name"), F.lit("billing_account").alias("type"), "provider", F.lit(None).cast("string").alias("parent_external_id"))
    kind = F.when(F.col("provider") == "azure", "subscription").otherwise("account")
    accounts = known.select(F.lower("account_id").alias("external_id"), F.col("account_name").alias("name"), kind.alias("type"), "provider", F.lower("billing_id").alias("parent_external_id"))
    return latest(bills.union(accounts), ["external_id"], "name")


def azure_hierarchy(resources: DataFrame) -> DataFrame:
    """Subscriptions and resource groups on the way to resource paths (resource_id)."""
    sub = F.regexp_extract(F.lower("resource_id"), "/subscriptions/([^/]+)", 1)
    group = F.regexp_extract(F.lower("resource_id"), "/resourcegroups/([^/]+)", 1)
    rows = resources.select(sub.alias("sub"), group.alias("grp")).where("sub <> ''").distinct()
    subs = rows.select(F.concat(F.lit("/subscriptions/"), "sub").alias("external_id"), F.col("sub").alias("name"), F.lit("subscription").alias("type"), F.lit(None).cast("string").alias("parent_external_id"))
    groups = rows.where("grp <> ''").select(F.concat(F.lit("/subscriptions/"), "sub", F.lit("/resourcegroups/"), "grp").alias("external_id"), F.col("grp").alias("name"), F.lit("resource_group").alias("type"), F.concat(F.lit("/subscriptions/"), "sub").alias("parent_external_id"))
    return subs.union(groups).distinct()


def surrogate(external_id: Column) -> Column:
    """An entity's id from its external id; 0 is kept for the root."""
    return F.xxhash64(F.lower(external_id))


def pricing_dedupe(prices: DataFrame) -> DataFrame:
    """The cheapest row per cloud, type, region and system.

    Prices are dealt out by key before they are grouped: hardly any repeat, so a task that grouped what it read would hold
    all of it, and a small file with many rows makes few tasks.
    """
    keys = ["cloud", "instance_type", "region", "os"]
    return prices.repartition(*keys).groupBy(*keys).agg(F.min("hourly_price").alias("hourly_price"))


def lowered(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with the given text columns in lower case, as keys are stored."""
    return rows.withColumns({c: F.lower(c) for c in columns})


def basic_entities(rows: DataFrame) -> DataFrame:
    """Entities (external_id, provider, name, type, any others) as they are stored: in lower case, the external id for a missing name."""
    missing = F.coalesce(F.lower("name").isin("", "none"), F.lit(True))
    named = rows.withColumn("name", F.when(missing, F.col("external_id")).otherwise(F.col("name")))
    return lowered(named, "external_id", "provider", "name", "type")


def cluster_of(urn: Column) -> Column:
    """A cluster's external id: its namespace's without the last ``:`` part."""
    return F.regexp_extract(F.lower(urn), "(?s)^(.*):[^:]*$", 1)


def kube_entities(rows: DataFrame) -> DataFrame:
    """(external_id, provider, name, type, parent_external_id, tags) of the clusters and namespaces of metric rows.

    ``rows`` has resource_id, resource_name, resource_type, provider and tags. A cluster is named by
    the tag ``cluster``, or ``unknown-cluster``; of several names the largest stays.
    """
    none = F.lit(None)
    spaces = rows.select(F.col("resource_id").alias("external_id"), "provider", F.col("resource_name").alias("name"), F.col("resource_type").alias("type"), cluster_of(F.col("resource_id")).alias("parent_external_id"), "tags")
    name = F.coalesce(F.try_element_at("tags", F.lit("cluster")), F.lit("unknown-cluster"))
    clusters = rows.select(cluster_of(F.col("resource_id")).alias("external_id"), "provider", name.alias("name"), F.lit("kubernetes_cluster").alias("type"), none.cast("string").alias("parent_external_id"), none.cast("map<string,string>").alias("tags"))
    return latest(basic_entities(spaces.union(clusters)), ["external_id"], "name")


def stamped(rows: DataFrame, time: str = "envelope_time", column: str = "scanned") -> DataFrame:
    """Rows of a scan under the time of their envelope, or of the load if it has none."""
    return rows.withColumn(column, F.coalesce(F.col(time), F.current_timestamp())).drop(time)


def upsert_partitions(path: str, source: DataFrame, keys: list[str], policy: dict[str, str], partition: str) -> None:
    """Apply ``source`` to the table at ``path``, rewriting only the partitions that it touches.

    ``partition`` is one of ``keys``, so no other partition can hold a changed row: the target is
    read through a semi-join on it, which prunes its files. Spark replaces the partitions when all
    tasks are done; run again, the same source gives the same table. Adaptive execution splits a
    large partition into several tasks and files. A table that isn't there yet is created from ``source`` in one pass;
    otherwise ``source`` is written once, as it is read twice, and may be made from the table itself. It is unique by key.
    """
    if partition not in keys:
        raise ValueError("the partition column has to be one of the keys")
    spark = source.sparkSession
    out = source
    if exists(spark, path):
        source = durable(source, "upsert-source")
        touched = source.select(partition).distinct()
        out = upsert(spark.read.parquet(path).join(touched, partition, "left_semi"), source, keys, policy)
    out.hint("rebalance", F.col(partition)).write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole snapshots of a table, in order. Spark marks a snapshot as whole when its last task is done."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def publish(df: DataFrame, folder: str) -> int:
    """Write a table as its next snapshot and return the snapshot's number.

    Readers of :func:`current` see the snapshot before until the new one is whole; a failed write is
    never seen, and the next one writes over it. One writer at a time.
    """
    number = max(snapshots(df.sparkSession, folder), default=0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/snapshot={number}")
    return number


def expire(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` whole snapshots and return the removed ones' numbers; what a reader of an older one has open is lost."""
    old = snapshots(spark, folder)[:-keep]
    for number in old:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot={number}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return old


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest whole snapshot of a table."""
    return spark.read.parquet(f"{folder}/snapshot={snapshots(spark, folder)[-1]}")
