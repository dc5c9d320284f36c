"""Billing exports in the FOCUS layout: scan, daily and multi-day charges, spreading, normalisation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costloom.functions.normalize import account_of, provider_of
from costloom.operators.upsert import exists

TEXTS = ["ProviderName", "BillingAccountId", "BillingAccountName", "SubAccountId", "SubAccountName", "RegionId", "ResourceId", "ResourceName", "ResourceType", "ServiceCategory", "ServiceName", "SkuPriceId", "ChargeCategory", "BillingCurrency", "Tags"]
FOCUS = T.StructType([T.StructField(c, T.StringType()) for c in TEXTS] + [T.StructField("EffectiveCost", T.DoubleType()), T.StructField("ChargePeriodStart", T.TimestampType()), T.StructField("ChargePeriodEnd", T.TimestampType())])
#: A charge's key.
KEYS = ["ProviderName", "BillingAccountId", "BillingAccountName", "SubAccountId", "SubAccountName", "RegionId", "resource_id", "ServiceCategory", "ServiceName", "SkuPriceId", "BillingCurrency", "start_date"]


def focus_scan(spark: SparkSession, path: str) -> DataFrame:
    """Export files (CSV, also gzip) with a header; columns are taken by name."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FOCUS.fields])


#: The column with the text of a row that can't be read.
CORRUPT = "corrupt"


def read_exports(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows of export files or folders (CSV with a header, also gzip), whose headers may differ.

    Columns are taken by name: those that a file lacks are null, those that the layout doesn't know are in the map ``extra``.
    A row with too few or too many fields, or whose cost or times can't be read, has its text in ``corrupt``, else null. ``file`` is
    where it comes from. Files with one header are one scan; headers are read file by file on the driver.
    """
    groups: dict[tuple, list[str]] = {}
    for f in files:
        groups.setdefault(tuple(spark.read.option("header", True).csv(f).columns), []).append(f)
    out = None
    for header, own in sorted(groups.items()):
        shape = T.StructType([T.StructField(c, T.StringType()) for c in (*header, CORRUPT)])
        rows = spark.read.schema(shape).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(own)
        rows = rows.withColumn("file", F.col("_metadata.file_path"))
        known = {f.name: f.dataType for f in FOCUS.fields}
        unread = F.lit(False)
        for c, kind in known.items():
            if c in header and not isinstance(kind, T.StringType):
                unread = unread | (F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull())
        more = [c for c in header if c not in known]
        extra = F.create_map(*[x for c in more for x in (F.lit(c), F.col(c))]) if more else F.create_map()
        text = F.coalesce(F.col(CORRUPT), F.when(unread, F.to_json(F.struct(*header))))
        part = rows.select(*[(F.col(c).try_cast(kind) if c in header else F.lit(None).cast(kind)).alias(c) for c, kind in known.items()], extra.cast("map<string,string>").alias("extra"), text.alias(CORRUPT), "file")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], T.StructType([*FOCUS.fields, T.StructField("extra", T.MapType(T.StringType(), T.StringType())), T.StructField(CORRUPT, T.StringType()), T.StructField("file", T.StringType())]))


def export_stream(manifests: DataFrame, folder: str, **trigger):
    """Read the files that a stream of manifests (export, run, completed, files) names, each once.

    Of a batch's manifests the newest completed runs count (:func:`export_latest_manifest`); files that an earlier batch has read
    are left out. Good rows go to ``rows``, the others to ``rejects``, and the names of the files to ``files`` under ``folder``, one
    part a batch, which is written anew if the batch comes again. The query's checkpoint lies there as well.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = export_latest_manifest(batch).select("file").distinct()
        if exists(spark, f"{folder}/files"):
            before = spark.read.parquet(f"{folder}/files").where(F.col("batch") < batch_id)
            files = files.join(before, "file", "left_anti")
        names = sorted(r["file"] for r in files.collect())  # a batch's files
        rows = read_exports(spark, names)
        rows.where(f"{CORRUPT} IS NULL").drop(CORRUPT).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        rows.where(f"{CORRUPT} IS NOT NULL").select(CORRUPT, "file").write.mode("overwrite").parquet(f"{folder}/rejects/batch={batch_id}")
        spark.createDataFrame([(n,) for n in names], "file string").write.mode("overwrite").parquet(f"{folder}/files/batch={batch_id}")

    return manifests.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def with_dates(raw: DataFrame) -> DataFrame:
    """Scanned rows with their charge period as dates."""
    return raw.withColumn("start_date", F.to_date("ChargePeriodStart")).withColumn("end_date", F.to_date("ChargePeriodEnd"))


def _charges(raw: DataFrame) -> DataFrame:
    rows = raw.where("EffectiveCost <> 0 AND ChargeCategory <> 'Credit'").withColumn("resource_id", F.coalesce("ResourceId", F.concat("SubAccountId", F.lit(":general"))))
    other = [F.max(c).alias(c) for c in ("ResourceName", "ResourceType", "Tags") if c in raw.columns]
    return rows.groupBy(*KEYS).agg(*other, F.max("end_date").alias("end_date"), F.sum("EffectiveCost").alias("billed_cost"))


def focus_daily_charges(raw: DataFrame, cutoff: dt.date) -> DataFrame:
    """Charges of at most one day that start at or after the cutoff, summed by key; no credits, no zero costs.

    Rows without a charge category are dropped. Of several names, types or tags the largest stays.
    """
    return _charges(raw.where((F.datediff("end_date", "start_date") <= 1) & (F.col("start_date") >= F.lit(cutoff))))


def focus_multiday_charges(raw: DataFrame, cutoff: dt.date) -> DataFrame:
    """Charges of more than one day that end after the cutoff, summed by key."""
    return _charges(raw.where((F.datediff("end_date", "start_date") > 1) & (F.col("end_date") > F.lit(cutoff))))


def spread_multiday(charges: DataFrame, as_of: dt.date, mode: str = "elapsed") -> DataFrame:
    """One row per day of a charge, with an equal part of the cost.

    ``elapsed`` deals a charge that isn't over by ``as_of`` out over the days so far, ``full`` over
    all its days up to ``as_of``. Charges without a whole day so far have no rows. No cutoff is
    applied to the days.
    """
    end = F.least("end_date", F.lit(as_of))
    shown = F.datediff(end, "start_date")
    parts = shown if mode == "elapsed" else F.datediff("end_date", "start_date")
    rows = charges.withColumn("__n", parts).withColumn("__shown", shown).where("__shown > 0")
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__shown") - 1)))
    rows = rows.withColumn("billed_cost", F.col("billed_cost") / F.col("__n")).withColumn("start_date", F.date_add("start_date", F.col("__k")))
    return rows.withColumn("end_date", F.date_add("start_date", 1)).drop("__n", "__shown", "__k")


def focus_normalize(charges: DataFrame) -> DataFrame:
    """Charges with unified provider, account, resource, tags and defaults."""
    def text(c: str, default: str = "Unknown"):
        return F.coalesce(F.col(c), F.lit(default))

    resource = F.when(F.coalesce("resource_id", F.lit("")) != "", F.col("resource_id")).otherwise(text("ServiceName", "general"))
    tags = F.coalesce(F.from_json(F.col("Tags"), "map<string,string>"), F.create_map().cast("map<string,string>")) if "Tags" in charges.columns else F.create_map().cast("map<string,string>")
    return charges.select(
        provider_of(F.col("ProviderName")).alias("provider"), text("BillingAccountId").alias("billing_id"), text("BillingAccountName").alias("billing_name"),
        account_of(text("SubAccountId", "")).alias("account_id"), text("SubAccountName").alias("account_name"), text("RegionId").alias("region_id"), resource.alias("resource_id"),
        F.coalesce(F.col("ResourceName"), resource).alias("resource_name"), text("ResourceType").alias("resource_type"), tags.alias("tags"), text("ServiceName").alias("service_name"),
        text("ServiceCategory").alias("service_category"), text("SkuPriceId").alias("sku_price_id"), F.col("start_date").alias("charge_start"), F.col("end_date").alias("charge_end"),
        F.coalesce("billed_cost", F.lit(0.0)).alias("billed_cost"), text("BillingCurrency", "EUR").alias("billing_currency"),
    )


def costs_from_export(raw: DataFrame, as_of: dt.date, days_back: int = 7) -> DataFrame:
    """Normalised daily costs of an export: daily charges and spread multi-day ones."""
    cutoff = as_of - dt.timedelta(days=days_back)
    return focus_normalize(focus_daily_charges(raw, cutoff).unionByName(spread_multiday(focus_multiday_charges(raw, cutoff), as_of)))


def export_latest_manifest(manifests: DataFrame) -> DataFrame:
    """(export, run, file): data files of each export's newest completed run, and of a second run of the same day.

    ``manifests`` has export, run, completed (timestamp, null if open) and files (array).
    """
    done = manifests.where("completed IS NOT NULL")
    newest = done.groupBy("export").agg(F.max(F.to_date("completed")).alias("day"))
    rows = done.join(newest, "export").where(F.to_date("completed") == F.col("day"))
    top = rows.groupBy("export").agg(F.slice(F.sort_array(F.collect_set(F.struct("completed", "run")), asc=False), 1, 2).alias("runs"))
    runs = top.select("export", F.explode("runs").alias("r")).select("export", "r.run")
    return rows.join(runs, ["export", "run"]).select("export", "run", F.explode("files").alias("file")).distinct()
