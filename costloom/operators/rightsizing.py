"""Fleet-wide rightsizing: telemetry, needs, candidates with warnings, idle machines and recommendations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from costloom.functions.tables import durable
from costloom.functions.tags import glob_to_like, tags_key
from costloom.operators.tagjoin import containing

FLAGS = ["architecture", "is_gpu", "is_confidential", "has_local_storage", "supports_premium"]


def vm_metadata(vms: DataFrame, hardware: DataFrame) -> DataFrame:
    """Machines with the hardware of their instance type; unknown types keep nulls."""
    return vms.join(hardware.select("instance_type", "vcpu", "memory_gb", *FLAGS), "instance_type", "left")


def vm_telemetry(metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per entity: p95 of the processor metric, maxima of the others.

    ``names`` maps output columns (cpu_p95, ram_max, ...) to metric names. One conditional aggregate.
    """
    out = []
    for column, metric in names.items():
        value = F.when(F.col("metric") == metric, F.col("value"))
        out.append((F.percentile(value, 0.95) if column == "cpu_p95" else F.max(value)).alias(column))
    return metrics.groupBy("entity_id").agg(*out)


def vm_requirements(meta: DataFrame, target_cpu: float = 85.0, target_ram: float = 80.0) -> DataFrame:
    """Needs of machines with telemetry columns: size times observed over target, at least 1.

    Targets of 0 or less count as 1; missing telemetry keeps the present size. Azure limits outbound
    traffic only, others the larger direction (in Mbit/s).
    """
    target_cpu, target_ram = max(target_cpu, 1.0) if target_cpu > 0 else 1.0, max(target_ram, 1.0) if target_ram > 0 else 1.0
    mb = 1_000_000.0
    net_in, net_out = (F.coalesce(c, F.lit(0.0)) / mb for c in ("net_in_max", "net_out_max"))
    return meta.select(
        "*",
        F.greatest(F.lit(1.0), F.coalesce(F.col("vcpu") * F.col("cpu_p95") / target_cpu, F.col("vcpu").cast("double"))).alias("need_vcpu"),
        F.greatest(F.lit(1.0), F.coalesce(F.col("memory_gb") * F.col("ram_max") / target_ram, F.col("memory_gb").cast("double"))).alias("need_ram"),
        (F.coalesce("disk_read_max", F.lit(0.0)) + F.coalesce("disk_write_max", F.lit(0.0))).alias("need_iops"),
        F.when(F.lower("provider") == "azure", net_out).otherwise(F.greatest(net_in, net_out)).alias("need_net"),
    )


def vm_idle() -> Column:
    """Whether all present telemetry is below the idle limits, and there is any."""
    checks = F.array(*[F.col(c) < limit for c, limit in (("cpu_p95", 5.0), ("ram_max", 5.0), ("disk_read_max", 50.0), ("disk_write_max", 50.0), ("net_in_max", 5e6), ("net_out_max", 5e6))])
    present = F.filter(checks, lambda x: x.isNotNull())
    return (F.size(present) > 0) & F.forall(present, lambda x: x)


#: What a candidate (``c_`` columns) may not have in common with a machine.
WARNING_NAMES = ["architecture", "confidential", "local storage", "premium storage"]


def warning_mask(offer: Column | None = None) -> Column:
    """The warnings of an offer (columns, or the fields of a struct) as bits, in the order of their names."""

    def of(name: str) -> Column:
        return F.col("c_" + name) if offer is None else offer["c_" + name]

    checks = [of("architecture") != F.col("architecture"), *[F.col(f) & ~of(f) for f in ("is_confidential", "has_local_storage", "supports_premium")]]
    mask = F.lit(0)
    for k, c in enumerate(checks):
        mask = mask + F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0)
    return mask


def warnings_of(mask: Column) -> Column:
    """The names of a mask's warnings, sorted: one of the sets that there are, which are literals."""
    sets = [sorted(name for k, name in enumerate(WARNING_NAMES) if m >> k & 1) for m in range(1 << len(WARNING_NAMES))]
    return F.element_at(F.array(*[F.array(*[F.lit(n) for n in names]).cast("array<string>") for names in sets]), mask + 1)


def offers_of(hardware: DataFrame, pricing: DataFrame, excluded: Column | None = None, net_capacity: str = "throughput") -> DataFrame:
    """Priced types with their hardware in ``c_`` columns; those that fit a glob pattern of ``excluded`` are left out.

    ``net_capacity`` is the hardware column that a machine's network needs are held against; null there is no limit.
    """
    offers = pricing.where("hourly_price > 0").join(hardware, ["cloud", "instance_type"])
    offers = offers.select(F.col("cloud").alias("provider"), "region", "os", F.col("instance_type").alias("candidate"), F.col("hourly_price").alias("candidate_price"), F.col("vcpu").alias("c_vcpu"), F.col("memory_gb").alias("c_memory"), "baseline_iops", F.col(net_capacity).cast("double").alias("throughput"), *[F.col(f).alias("c_" + f) for f in FLAGS])
    return offers if excluded is None else offers.where(~F.exists(excluded, lambda p: F.like(F.col("candidate"), glob_to_like(p))))


KEY = ["provider", "region", "os"]
#: An offer's capacities; a missing one is unlimited.
CAPACITIES = ["c_vcpu", "c_memory", "baseline_iops", "throughput"]
NEEDS = ["need_vcpu", "need_ram", "need_iops", "need_net"]
#: What offers are held against.
ASKED = [*KEY, *NEEDS, *FLAGS]


def has_room(offer: Column | None = None, machine: Column | None = None) -> Column:
    """Whether an offer's capacities meet a machine's needs; either is columns, or the fields of a struct."""

    def of(name: str) -> Column:
        return F.col(name) if offer is None else offer[name]

    def need(name: str) -> Column:
        return F.col(name) if machine is None else machine[name]

    return (
        (of("c_vcpu") >= need("need_vcpu")) & (of("c_memory") >= need("need_ram"))
        & (of("baseline_iops").isNull() | (of("baseline_iops") >= need("need_iops")))
        & (of("throughput").isNull() | (of("throughput") >= need("need_net")))
    )


def fits(offer: Column | None = None) -> Column:
    """Whether an offer (columns, or the fields of a struct) meets a machine's needs and has its kind of processor."""
    return has_room(offer) & ((F.col("c_is_gpu") if offer is None else offer["c_is_gpu"]) == F.col("is_gpu"))


def met(asked: DataFrame, offers: DataFrame, salts: int = 32) -> DataFrame:
    """Machines (or groups of them) joined with the offers of their cloud, region, system and kind of processor that meet their needs.

    These keys have few values: machines are dealt out to ``salts`` parts of each, in which every offer stands. The parts
    count by pairs and not by bytes, so their number is fixed. Neither side is held whole by a task.
    """
    on = [*KEY, "is_gpu", "__salt"]
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = asked.withColumn("__salt", F.pmod(F.xxhash64(*asked.columns), F.lit(salts)).cast("int")).repartition(parts, *on)
    copies = offers.withColumn("is_gpu", F.col("c_is_gpu")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return own.join(copies, on).where(fits()).drop("__salt")


def offer_blocks(offers: DataFrame, most: int = 1000) -> DataFrame:
    """Offers of equal capacities and flags as arrays ``__types`` of at most ``most`` names with their prices.

    They are numbered within a hash of their size, so they are shuffled once: Spark doesn't see that floating-point keys are
    dealt out alike for windows and groups. Where hashes collide, blocks are only smaller.
    """
    size = [*KEY, *CAPACITIES, *["c_" + f for f in FLAGS]]
    place = F.row_number().over(W.partitionBy("__size").orderBy("candidate"))
    numbered = offers.withColumn("__size", F.xxhash64(*size)).withColumn("__block", F.floor((place - 1) / most))
    return numbered.groupBy("__size", "__block", *size).agg(F.collect_list(F.struct("candidate", "candidate_price")).alias("__types")).drop("__size", "__block")


def machine_blocks(needs: DataFrame, most: int = 1000) -> DataFrame:
    """Machines of one cloud, region, system and equal flags as arrays ``__machines`` of at most ``most`` needs with ids.

    These keys have few values, so machines are dealt out by ranges that reach to the id, and numbered where they stand.
    """
    order = [*KEY, *FLAGS, *NEEDS, "id"]
    dealt = needs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.withColumn("__block", F.floor(F.monotonically_increasing_id() / most))
    return numbered.groupBy(*KEY, *FLAGS, "__block").agg(F.collect_list(F.struct("id", *NEEDS)).alias("__machines")).drop("__block")


def listed_fits(needs: DataFrame, offers: DataFrame, warnings: Callable[[Column], Column] = warnings_of, salts: int = 8, most: int = 1000) -> DataFrame:
    """(id, candidate, candidate_price, warnings): every offer that meets a machine's needs.

    Blocks of machines of equal flags meet blocks of offers of one size. For a pair of blocks the ids that fit are picked, and
    ``warnings`` of a mask are found, once; only the rows themselves are made for each fit. Their number grows with
    machines times types. An offer's rows come one after another, so that files hold its name and price once for many ids.
    Each offer stands in one of ``salts`` parts of its key, and the machines, which are smaller, in all of them.
    """
    on = [*KEY, "is_gpu", "__salt"]
    parts = int(needs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = offer_blocks(offers, most)
    own = sizes.withColumn("is_gpu", F.col("c_is_gpu")).withColumn("__salt", F.pmod(F.xxhash64(*sizes.columns), F.lit(salts)).cast("int")).repartition(parts, *on)
    copies = machine_blocks(needs, most).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # merged, as the work goes by pairs: beside broadcast machines few tasks would read all offers
    met_blocks = own.join(copies.hint("merge"), on)
    ids = F.transform(F.filter("__machines", lambda m: has_room(machine=m)), lambda m: m["id"])
    # a step of its own: beside inline, ids and warnings would be found for each fit
    found = met_blocks.select(ids.alias("__ids"), warnings(warning_mask()).alias("warnings"), "__types")
    typed = found.select("__ids", F.inline("__types"), "warnings")
    return typed.select(F.explode("__ids").alias("id"), "candidate", "candidate_price", "warnings")


def vm_candidates(needs: DataFrame, hardware: DataFrame, pricing: DataFrame, excluded: Column | None = None, net_capacity: str = "throughput", salts: int = 8) -> DataFrame:
    """(id, candidate, candidate_price, warnings): every priced type that meets a machine's needs.

    ``excluded`` is an array of glob patterns. The result has a row for every fit, so it grows with machines times
    types; :func:`warning_counts`, :func:`best_candidates` and :func:`vm_rightsize` don't need it.
    """
    return listed_fits(needs, offers_of(hardware, pricing, excluded, net_capacity), salts=salts)


def warning_counts(needs: DataFrame, hardware: DataFrame, pricing: DataFrame, excluded: Column | None = None, net_capacity: str = "throughput") -> DataFrame:
    """(warnings, n): in how many fits of all machines each set of warnings occurs.

    Offers of equal capacities and flags are one row with their number, and so are machines of equal needs; a pair of
    such groups counts for all its fits. So the work grows with the machines times the different sizes of a catalogue.
    """
    flags = ["c_" + f for f in FLAGS]
    sizes = offers_of(hardware, pricing, excluded, net_capacity).groupBy(*KEY, *CAPACITIES, *flags).agg(F.count(F.lit(1)).alias("__offers"))
    asked = needs.groupBy(*ASKED).agg(F.count(F.lit(1)).alias("__machines"))
    counts = met(asked, sizes).groupBy(warning_mask().alias("mask")).agg(F.sum(F.col("__machines") * F.col("__offers")).alias("n"))
    return counts.select(warnings_of(F.col("mask")).alias("warnings"), "n")


def skyband(offers: DataFrame, by: list[str], k: int = 1) -> DataFrame:
    """The offers that fewer than ``k`` others of their group ``by`` dominate; for 1 the Pareto frontier.

    One offer dominates another if it comes before it by price and name and has at least its
    capacities. So the ``k`` cheapest fits of any machine are in the result. Groups are catalogues of one
    cloud, region and system, or parts of them. Spark first leaves the ``k`` cheapest of equal capacities, so a group
    in memory holds the different sizes of a catalogue and not its types.
    """
    same = W.partitionBy(*by, *CAPACITIES).orderBy("candidate_price", "candidate")
    # dealt out first: a small catalogue file with many prices is read by few tasks
    few = offers.repartition(*by, *CAPACITIES).withColumn("__place", F.row_number().over(same)).where(F.col("__place") <= k).drop("__place")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["candidate_price", "candidate"], kind="stable")
        rooms = pdf[CAPACITIES].astype(float).fillna(np.inf).to_numpy()
        band, keep = np.empty((0, len(CAPACITIES))), []
        for i, own in enumerate(rooms):
            # whatever is dominated k times has k dominators in the band
            if int((band >= own).all(1).sum()) < k:
                keep.append(i)
                band = np.vstack([band, own])
        return pdf.iloc[keep]

    return few.groupBy(*by).applyInPandas(run, offers.schema)


def ladders(offers: DataFrame, by: list[str]) -> DataFrame:
    """(by, ladder): a group's offers as one array in the order of price and name."""
    rest = [c for c in offers.columns if c not in (*by, "candidate_price", "candidate")]
    return offers.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("candidate_price", "candidate", *rest))).alias("ladder"))


def with_ladder(vms: DataFrame, offers: DataFrame, salts: int) -> DataFrame:
    """Machines with the ladder of their cloud, region and system, which few values share: each ladder stands in ``salts`` parts of the join."""
    steps = ladders(offers, KEY).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return vms.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(steps, [*KEY, "__salt"])


def best_candidates(needs: DataFrame, hardware: DataFrame, pricing: DataFrame, excluded: Column | None = None, k: int = 10, salts: int = 8, net_capacity: str = "throughput") -> DataFrame:
    """(id, position, candidate, candidate_price, warnings): the ``k`` cheapest fits of every machine, by price and name.

    Machines meet one array of the offers that can be among the best; their fits are picked inside the row, so
    at most ``k`` rows a machine are made.
    """
    offers = skyband(offers_of(hardware, pricing, excluded, net_capacity), [*KEY, "c_is_gpu"], k)
    asked = needs.select("id", *KEY, "need_vcpu", "need_ram", "need_iops", "need_net", *FLAGS)
    picked = with_ladder(asked, offers, salts).withColumn("__best", F.slice(F.filter("ladder", fits), 1, k))
    found = F.transform("__best", lambda x: F.struct(x["candidate"].alias("candidate"), x["candidate_price"].alias("candidate_price"), warnings_of(warning_mask(x)).alias("warnings")))
    rows = picked.select("id", F.posexplode(found).alias("__pos", "x"))
    return rows.select("id", (F.col("__pos") + 1).alias("position"), "x.*")


def cheapest(vms: DataFrame, offers: DataFrame, salts: int = 32) -> DataFrame:
    """(id, candidate, candidate_price, warnings): the cheapest fit for every set of warnings, up to the first without any.

    ``vms`` has the needs and the present ``price``. Among offers of the same flags only the Pareto
    frontier can hold an answer; its offers are numbered by price and name. Each machine keeps the lowest number for every
    set of warnings, as a plain minimum while the pairs are made. So the work grows with machines times frontier.
    """
    order = W.partitionBy(*KEY).orderBy("candidate_price", "candidate")
    rungs = durable(skyband(offers, [*KEY, *["c_" + f for f in FLAGS]]).withColumn("rung", F.row_number().over(order)), "rungs")
    hit = met(vms, rungs.drop("candidate"), salts).where("price IS NULL OR price <= 0 OR candidate_price < price")
    first = hit.groupBy("id", *KEY, warning_mask().alias("mask")).agg(F.min("rung").alias("rung"))
    clean = F.min(F.when(F.col("mask") == 0, F.col("rung"))).over(W.partitionBy("id"))
    kept = first.withColumn("__clean", clean).where("__clean IS NULL OR rung <= __clean")
    named = kept.join(rungs.select(*KEY, "rung", "candidate", "candidate_price"), [*KEY, "rung"])
    return named.select("id", "candidate", "candidate_price", warnings_of(F.col("mask")).alias("warnings"))


def vm_rightsize(needs: DataFrame, hardware: DataFrame, pricing: DataFrame, daily_cost: DataFrame, excluded: Column | None = None, net_capacity: str = "throughput") -> DataFrame:
    """(id, status, action, position, recommended, warnings, daily_cost, monthly_savings, savings_percent).

    Per machine: the cheapest candidate below the present price for every distinct set of warnings,
    up to the first without warnings; before them a shutdown if the machine is idle (position 0).
    Without a present price all candidates count and there are no savings. Machines without a
    type are ``unsupported``, those without anything to recommend have the action ``none``.
    """
    present = pricing.select(F.col("cloud").alias("provider"), "region", "os", "instance_type", F.col("hourly_price").alias("price"))
    known = durable(needs.withColumn("idle", vm_idle()).join(present, ["provider", "region", "os", "instance_type"], "left").join(daily_cost, "id", "left"), "machines")
    vms = known.select("id", "instance_type", "idle", "price", F.coalesce("daily_cost", F.lit(0.0)).alias("daily_cost"))
    asked = known.select("id", "provider", "region", "os", "price", "need_vcpu", "need_ram", "need_iops", "need_net", *FLAGS)
    rows = cheapest(asked, offers_of(hardware, pricing, excluded, net_capacity)).join(vms, "id")
    key = F.array_join("warnings", "|")
    order = W.partitionBy("id").orderBy("candidate_price", "candidate")
    rows = rows.withColumn("position", F.row_number().over(order))
    priced = F.col("price") > 0
    ratio = (F.col("price") - F.col("candidate_price")) / F.col("price")
    better = rows.select(
        "id", F.lit("success").alias("status"), F.lit("downsize_recommended").alias("action"), "position", F.col("candidate").alias("recommended"), key.alias("warnings"),
        F.when(priced, F.col("daily_cost") * (1 - ratio)).alias("projected_daily_cost"), F.when(priced, F.col("daily_cost") * ratio * 30).alias("monthly_savings"), F.when(priced, ratio * 100).alias("savings_percent"),
    )
    off = vms.where("idle AND instance_type IS NOT NULL").select(
        "id", F.lit("success").alias("status"), F.lit("downsize_recommended").alias("action"), F.lit(0).alias("position"), F.lit("shutdown").alias("recommended"), F.lit("idle").alias("warnings"),
        F.when(priced, 0.0).alias("projected_daily_cost"), F.when(priced, F.col("daily_cost") * 30).alias("monthly_savings"), F.when(priced, 100.0).alias("savings_percent"),
    )
    found = better.union(off)
    status = F.when(F.col("instance_type").isNull(), "unsupported").otherwise("success")
    none = vms.join(found.select("id").distinct(), "id", "left_anti").select("id", status.alias("status"), F.lit("none").alias("action"), F.lit(None).cast("int").alias("position"), *[F.lit(None).cast(t).alias(c) for c, t in (("recommended", "string"), ("warnings", "string"), ("projected_daily_cost", "double"), ("monthly_savings", "double"), ("savings_percent", "double"))])
    return found.union(none)


def exclusion_exact(rules: DataFrame, scopes: DataFrame) -> DataFrame:
    """Patterns of the rules with exactly a scope's id and tags."""
    keyed = rules.select("scope_id", tags_key(F.col("tags")).alias("tags_key"), "patterns")
    return scopes.select("scope_id", tags_key(F.col("tags")).alias("tags_key")).join(keyed, ["scope_id", "tags_key"])


def exclusion_for_entity(rules: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, patterns): all patterns of rules whose tags an entity holds; rules without tags hold for all.

    Rules are met through their rarest tag; those without any are one array for every entity.
    """
    own = containing(entities.select("id", "tags"), rules.select(F.col("tags").alias("rule_tags"), "patterns"), "rule_tags")
    general = rules.where(F.size("tags") == 0).select(F.explode("patterns").alias("pattern"))
    some = own.select("id", F.explode("patterns").alias("pattern"))
    everywhere = general.agg(F.collect_set("pattern").alias("__all"))  # one row
    per = entities.select("id").join(some.groupBy("id").agg(F.collect_set("pattern").alias("p")), "id", "left")
    patterns = F.array_sort(F.array_union(F.coalesce("p", F.array().cast("array<string>")), F.col("__all")))
    return per.crossJoin(everywhere).select("id", patterns.alias("patterns"))


def krr_clusters(recommendations: DataFrame, entities: DataFrame) -> DataFrame:
    """(cluster_id, cluster, latest): clusters with their latest container scan."""
    spaces = entities.select(F.col("id").alias("entity_id"), F.col("parent_id").alias("cluster_id"))
    latest = recommendations.join(spaces, "entity_id").groupBy("cluster_id").agg(F.max("scanned").alias("latest"))
    return latest.join(entities.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster")), "cluster_id")


def krr_latest(recommendations: DataFrame, entities: DataFrame) -> DataFrame:
    """The recommendations of each cluster's latest scan."""
    spaces = entities.select(F.col("id").alias("entity_id"), F.col("parent_id").alias("cluster_id"), F.col("name").alias("namespace"))
    latest = krr_clusters(recommendations, entities).select("cluster_id", F.col("latest").alias("scanned"))
    return recommendations.join(spaces, "entity_id").join(latest, ["cluster_id", "scanned"])
