"""Flattening of landed JSON: metric points, Prometheus matrices, container scans, hardware and price lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions.normalize import arch_of_size, contains_any, first_value, os_of_price_name

_STATS = "average:double,maximum:double,minimum:double,total:double,count:double"
AZURE_METRICS = f"struct<id:string,name:string,`c7n:metrics`:map<string,struct<metrics_data:struct<value:array<struct<timeseries:array<struct<data:array<struct<time_stamp:string,{_STATS}>>>>>>>>>>"
AWS_METRICS = "struct<InstanceId:string,`c7n.metrics`:map<string,array<struct<Timestamp:string,Average:double,Maximum:double,Minimum:double,Sum:double,SampleCount:double>>>>"
SCAN = "struct<scans:array<struct<object:struct<namespace:string,name:string,kind:string,container:string,allocations:struct<requests:map<string,string>>>,recommended:struct<requests:map<string,struct<value:string>>>>>>"
SKUS = "struct<value:array<struct<resourceType:string,name:string,family:string,capabilities:array<struct<name:string,value:string>>>>>"
INSTANCE_TYPES = "struct<InstanceTypes:array<struct<InstanceType:string,VCpuInfo:struct<DefaultVCpus:int>,MemoryInfo:struct<SizeInMiB:double>,NetworkInfo:struct<NetworkPerformance:string>,ProcessorInfo:struct<SupportedArchitectures:array<string>>,GpuInfo:struct<Gpus:array<struct<Name:string>>>,NitroEnclavesSupport:string,InstanceStorageSupported:boolean,EbsInfo:struct<EbsOptimizedInfo:struct<BaselineIops:double,BaselineThroughputInMBps:double>>>>>"
RETAIL = "struct<Items:array<struct<meterName:string,productName:string,armSkuName:string,armRegionName:string,retailPrice:double>>>"
OFFERS = "struct<products:map<string,struct<productFamily:string,attributes:map<string,string>>>,terms:struct<OnDemand:map<string,map<string,struct<priceDimensions:map<string,struct<pricePerUnit:map<string,string>>>>>>>>"


def azure_metric_points(payloads: DataFrame) -> DataFrame:
    """(resource_id, metric, ts, value) from VM payloads with their first metric."""
    p = payloads.select(F.from_json("payload", AZURE_METRICS).alias("p")).where("p IS NOT NULL")
    one = p.select(F.col("p.id").alias("resource_id"), F.map_keys("p.c7n:metrics")[0].alias("metric"), F.map_values("p.c7n:metrics")[0].alias("m"))
    d = one.select("resource_id", "metric", F.explode(F.col("m.metrics_data.value")[0]["timeseries"][0]["data"]).alias("d"))
    return d.select("resource_id", "metric", F.to_timestamp("d.time_stamp").alias("ts"), first_value(*[F.col(f"d.{c}") for c in ("average", "maximum", "minimum", "total", "count")]).alias("value"))


def aws_metric_points(payloads: DataFrame) -> DataFrame:
    """(resource_id, metric, ts, value) from instance payloads with their first metric."""
    p = payloads.select(F.from_json("payload", AWS_METRICS).alias("p")).where("p IS NOT NULL")
    one = p.select(F.col("p.InstanceId").alias("resource_id"), F.map_keys(F.col("p")["c7n.metrics"])[0].alias("metric"), F.explode(F.map_values(F.col("p")["c7n.metrics"])[0]).alias("d"))
    return one.select("resource_id", "metric", F.to_timestamp("d.Timestamp").alias("ts"), first_value(*[F.col(f"d.{c}") for c in ("Average", "Maximum", "Minimum", "Sum", "SampleCount")]).alias("value"))


def matrix_series(payloads: DataFrame) -> DataFrame:
    """(cluster, series, reason, labels, namespace, points) of range-query payloads (cluster, payload), one row a series.

    Payloads are taken as VARIANT, so that one field of a wrong type doesn't hide the rest. ``reason`` says why
    nothing can be read: of a whole payload (``no JSON``, ``no result``, and then ``series`` is null) or of a series
    (``no namespace``, ``no values``); it is null for good ones. An empty result has no rows.
    """
    parsed = payloads.select("cluster", F.try_parse_json("payload").alias("v"))
    parsed = parsed.withColumn("result", F.try_variant_get("v", "$.data.result", "array<variant>"))
    whole = F.when(F.col("v").isNull(), "no JSON").when(F.col("result").isNull(), "no result")
    rows = parsed.select("cluster", whole.alias("reason"), F.posexplode_outer("result").alias("series", "s")).where("series IS NOT NULL OR reason IS NOT NULL")
    labels = F.try_variant_get("s", "$.metric", "map<string,string>")
    rows = rows.select("cluster", "series", "reason", labels.alias("labels"), F.try_variant_get("s", "$.values", "array<array<string>>").alias("points"))
    rows = rows.withColumn("namespace", F.try_element_at("labels", F.lit("namespace")))
    own = F.when(F.col("namespace").isNull(), "no namespace").when(F.coalesce(F.size("points"), F.lit(0)) <= 0, "no values")
    return rows.withColumn("reason", F.coalesce("reason", own))


def prom_matrix_points(payloads: DataFrame) -> DataFrame:
    """(urn, namespace, tags, ts, value) from range-query payloads (cluster, payload).

    ``label_*`` labels become tags. What can't be read is in :func:`prom_matrix_rejects`; values that are no numbers are null.
    """
    p = matrix_series(payloads).where("reason IS NULL")
    tags = F.transform_keys(F.map_filter("labels", lambda k, v: k.startswith("label_")), lambda k, v: F.substring(k, 7, 1000))
    v = p.select(F.concat("cluster", F.lit(":namespace/"), "namespace").alias("urn"), "namespace", tags.alias("tags"), F.explode("points").alias("v"))
    return v.select("urn", "namespace", "tags", F.timestamp_seconds(F.get("v", F.lit(0)).try_cast("double")).alias("ts"), F.get("v", F.lit(1)).try_cast("double").alias("value"))


def prom_matrix_rejects(payloads: DataFrame) -> DataFrame:
    """(cluster, series, reason) of the payloads and series that :func:`prom_matrix_points` leaves out."""
    return matrix_series(payloads).where("reason IS NOT NULL").select("cluster", "series", "reason")


def krr_scan_rows(payloads: DataFrame) -> DataFrame:
    """One row per scanned container from payloads (cluster, payload); scans without namespace or name are dropped."""
    p = payloads.select("cluster", F.explode(F.from_json("payload", SCAN)["scans"]).alias("s")).where("s.object.namespace IS NOT NULL AND s.object.name IS NOT NULL")

    def now(kind: str) -> Column:
        return F.try_element_at("s.object.allocations.requests", F.lit(kind))

    def wanted(kind: str) -> Column:
        return F.try_element_at("s.recommended.requests", F.lit(kind))["value"]

    return p.select(
        F.concat("cluster", F.lit(":namespace/"), F.col("s.object.namespace")).alias("urn"), F.col("s.object.kind").alias("workload_type"), F.col("s.object.name").alias("workload"), F.col("s.object.container").alias("container"),
        now("cpu").alias("cpu_now"), wanted("cpu").alias("cpu_wanted"), now("memory").alias("memory_now"), wanted("memory").alias("memory_wanted"),
    )


def azure_sku_hardware(payloads: DataFrame) -> DataFrame:
    """Hardware rows from SKU payloads: virtual machines only, one per name (the first in the payload)."""
    p = payloads.select(F.posexplode(F.from_json("payload", SKUS)["value"]).alias("pos", "s")).where("s.resourceType = 'virtualMachines'")
    p = p.groupBy(F.col("s.name").alias("instance_type")).agg(F.min_by("s", "pos").alias("s"))
    caps = F.map_from_entries(F.transform("s.capabilities", lambda c: F.struct(c["name"], c["value"])))
    p = p.select("instance_type", F.lower(F.coalesce("s.family", F.lit(""))).alias("family"), caps.alias("caps"))

    def cap(name: str) -> Column:
        return F.try_element_at("caps", F.lit(name))

    def number(name: str) -> Column:
        return F.coalesce(cap(name).try_cast("double"), F.lit(0.0))

    return p.select(
        F.lit("azure").alias("cloud"), "instance_type", "family", number("vCPUs").cast("int").alias("vcpu"), number("MemoryGB").alias("memory_gb"),
        F.nullif(number("UncachedDiskIOPS"), F.lit(0.0)).alias("baseline_iops"), (cap("UncachedDiskBytesPerSecond").try_cast("double") / 1048576).alias("throughput"), arch_of_size(F.col("instance_type")).alias("architecture"),
        (number("GPUs") > 0).alias("is_gpu"), (cap("ConfidentialComputingType").isNotNull() | contains_any(F.col("family"), "dc", "ec")).alias("is_confidential"),
        (number("MaxResourceVolumeMB") > 0).alias("has_local_storage"), (F.lower(F.coalesce(cap("PremiumIO"), F.lit("false"))) == "true").alias("supports_premium"),
    )


def aws_type_hardware(payloads: DataFrame) -> DataFrame:
    """Hardware rows from instance type payloads; network performance as Mbit/s."""
    t = payloads.select(F.explode(F.from_json("payload", INSTANCE_TYPES)["InstanceTypes"]).alias("t"))
    gigabit = F.regexp_extract("t.NetworkInfo.NetworkPerformance", "([0-9.]+) Gigabit", 1).try_cast("double") * 1000
    return t.select(
        F.lit("aws").alias("cloud"), F.lower("t.InstanceType").alias("instance_type"), F.split("t.InstanceType", "\\.")[0].alias("family"), F.col("t.VCpuInfo.DefaultVCpus").alias("vcpu"), (F.col("t.MemoryInfo.SizeInMiB") / 1024).alias("memory_gb"),
        F.col("t.EbsInfo.EbsOptimizedInfo.BaselineIops").alias("baseline_iops"), F.col("t.EbsInfo.EbsOptimizedInfo.BaselineThroughputInMBps").alias("throughput"), gigabit.alias("network_mbps"),
        F.when(F.array_contains("t.ProcessorInfo.SupportedArchitectures", "arm64"), "arm64").otherwise("x86_64").alias("architecture"), (F.coalesce(F.size("t.GpuInfo.Gpus"), F.lit(0)) > 0).alias("is_gpu"),
        (F.coalesce("t.NitroEnclavesSupport", F.lit("")) == "supported").alias("is_confidential"), F.coalesce("t.InstanceStorageSupported", F.lit(False)).alias("has_local_storage"), F.lit(True).alias("supports_premium"),
    )


def azure_price_rows(payloads: DataFrame) -> DataFrame:
    """Price rows from retail payloads without Spot, Low Priority and Promo meters."""
    i = payloads.select(F.explode(F.from_json("payload", RETAIL)["Items"]).alias("i"))
    i = i.where(~contains_any(F.coalesce("i.meterName", F.lit("")), "Spot", "Low Priority", "Promo"))
    return i.select(F.lit("azure").alias("cloud"), F.lower("i.armSkuName").alias("instance_type"), F.col("i.armRegionName").alias("region"), F.lower(os_of_price_name(F.col("i.productName"))).alias("os"), F.col("i.retailPrice").alias("hourly_price"))


def aws_price_rows(payloads: DataFrame) -> DataFrame:
    """Price rows from offer payloads (region, payload): products joined with their on-demand price dimensions."""
    p = payloads.select("region", F.from_json("payload", OFFERS).alias("p"))
    products = p.select("region", F.explode("p.products").alias("sku", "x")).where(
        (F.col("x.productFamily") == "Compute Instance") & (F.try_element_at("x.attributes", F.lit("tenancy")) == "Shared") & (F.try_element_at("x.attributes", F.lit("capacitystatus")) == "Used") & (F.try_element_at("x.attributes", F.lit("preInstalledSw")) == "NA")
    )
    terms = p.select("region", F.explode("p.terms.OnDemand").alias("sku", "t")).select("region", "sku", F.explode("t").alias("offer", "o"))
    prices = terms.select("region", "sku", F.explode("o.priceDimensions").alias("code", "d")).select("region", "sku", F.try_element_at("d.pricePerUnit", F.lit("USD")).cast("double").alias("hourly_price"))
    rows = products.join(prices, ["region", "sku"])
    return rows.select(F.lit("aws").alias("cloud"), F.lower(F.try_element_at("x.attributes", F.lit("instanceType"))).alias("instance_type"), "region", F.lower(os_of_price_name(F.try_element_at("x.attributes", F.lit("operatingSystem")))).alias("os"), "hourly_price")
