"""Daily costs of scopes, chargeback with Kubernetes shares, allocation rules and the month report."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from costloom.functions.normalize import usd_to_eur
from costloom.functions.tables import durable
from costloom.functions.tags import tags_contain, tags_key
from costloom.functions.timegrid import gap_filled
from costloom.operators.budgets import anomaly_entry
from costloom.operators.hierarchy import namespaces_for_tags, with_key
from costloom.operators.tagjoin import containing

SCOPE = ["scope_id", "tags_key"]


def entity_daily(costs: DataFrame, start: dt.date | None, end: dt.date | None, rate: float, *extra: str) -> DataFrame:
    """EUR costs per entity and day of [start, end), summed before anything is joined; None leaves a side open."""
    inside = costs if start is None else costs.where(F.col("charge_date") >= F.lit(start))
    inside = inside if end is None else inside.where(F.col("charge_date") < F.lit(end))
    eur = usd_to_eur(F.col("billed_cost"), F.col("currency"), rate)
    return inside.groupBy("entity_id", F.col("charge_date").alias("date"), *extra).agg(F.sum(eur).alias("cost"))


def daily_costs(members: DataFrame, scopes: DataFrame, costs: DataFrame, start: dt.date, end: dt.date, rate: float = 1.0) -> DataFrame:
    """(scope_id, tags_key, date, cost) for every day of [start, end), 0 on days without costs.

    ``members`` are the scopes' entities, see :func:`scope_entities`.
    """
    return scope_daily(members, scopes, entity_daily(costs, start, end, rate), start, end)


def scope_daily(members: DataFrame, scopes: DataFrame, per_entity: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The same from :func:`entity_daily` sums."""
    sums = per_entity.join(members, "entity_id").groupBy(*SCOPE, "date").agg(F.sum("cost").alias("cost"))
    return gap_filled(with_key(scopes).select(*SCOPE), sums, SCOPE, start, end, "cost")


def scope_sums(tree: DataFrame, entities: DataFrame, scopes: DataFrame, rows: DataFrame, *extra: str) -> DataFrame:
    """(scope_id, tags_key, date, extra, cost) of :func:`entity_daily` rows below each scope that hold its tags.

    Costs climb to their entities' ancestors and are summed by ancestor and the entities' tags, of which there are few sets;
    only these sums meet the scopes' tags. No table of the scopes' members is made.
    """
    own = entities.select(F.col("id").alias("entity_id"), F.array_sort(F.map_entries("tags")).alias("__tags"))
    asked = with_key(scopes).select("scope_id", "tags", "tags_key")
    up = tree.where("depth >= 1").select(F.col("ancestor").alias("scope_id"), F.col("descendant").alias("entity_id"))
    up = up.join(asked.select("scope_id").distinct(), "scope_id", "left_semi")
    sums = rows.join(own, "entity_id").join(up, "entity_id").groupBy("scope_id", "__tags", "date", *extra).agg(F.sum("cost").alias("cost"))
    found = sums.join(asked, "scope_id").where(tags_contain(F.map_from_entries("__tags"), F.col("tags")))
    return found.groupBy(*SCOPE, "date", *extra).agg(F.sum("cost").alias("cost"))


def daily_costs_by_category(members: DataFrame, costs: DataFrame, start: dt.date, end: dt.date, rate: float = 1.0) -> DataFrame:
    """(scope_id, tags_key, date, category, cost); costs without a category are ``Other``; no gaps filled."""
    rows = entity_daily(costs.withColumn("category", F.coalesce("category", F.lit("Other"))), start, end, rate, "category")
    return rows.join(members, "entity_id").groupBy(*SCOPE, "date", "category").agg(F.sum("cost").alias("cost"))


def daily_costs_by_tag(members: DataFrame, entities: DataFrame, costs: DataFrame, key: str, start: dt.date, end: dt.date, rate: float = 1.0) -> DataFrame:
    """(scope_id, tags_key, date, tag_value, cost); entities without the tag are ``Unrecognized``."""
    value = F.coalesce(F.try_element_at("tags", F.lit(key)), F.lit("Unrecognized"))
    named = entities.select(F.col("id").alias("entity_id"), value.alias("tag_value"))
    return entity_daily(costs, start, end, rate).join(members, "entity_id").join(named, "entity_id").groupBy(*SCOPE, "date", "tag_value").agg(F.sum("cost").alias("cost"))


def max_cost_date(costs: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The latest charge date in [start, end), null without one."""
    return costs.where((F.col("charge_date") >= F.lit(start)) & (F.col("charge_date") < F.lit(end))).agg(F.max("charge_date").alias("max_date"))


def ns_metric_share(kube_metrics: DataFrame, entities: DataFrame, metric: str, start: dt.date, end: dt.date) -> DataFrame:
    """(cluster_id, namespace, date, share): a namespace's daily mean over its cluster's sum of means.

    Every namespace with any value in the window has a row for every day; the share is null on days
    on which the cluster has none.
    """
    inside = kube_metrics.where((F.col("metric") == metric) & (F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
    named = entities.select(F.col("id").alias("entity_id"), F.col("parent_id").alias("cluster_id"), F.col("name").alias("namespace"))
    means = inside.join(named, "entity_id").groupBy("cluster_id", "namespace", "date").agg(F.avg("value").alias("value"))
    on = ["cluster_id", "namespace"]
    full = gap_filled(means.select(*on).distinct(), means, on, start, end, "value")
    total = full.groupBy("cluster_id", "date").agg(F.sum("value").alias("total"))
    return full.join(total, ["cluster_id", "date"]).select(*on, "date", F.try_divide("value", "total").alias("share"))


def ns_allocation(cpu: DataFrame, memory: DataFrame, cluster_costs: DataFrame, cpu_weight: float = 0.7, memory_weight: float = 0.3) -> DataFrame:
    """(cluster_id, namespace, date, cost): cluster costs dealt out by weighted shares.

    ``cluster_costs`` has cluster_id, date and cost. Missing shares and costs count 0.
    """
    on = ["cluster_id", "namespace", "date"]
    both = cpu.withColumnRenamed("share", "cpu").join(memory.withColumnRenamed("share", "memory"), on, "full")
    weight = cpu_weight * F.coalesce("cpu", F.lit(0.0)) + memory_weight * F.coalesce("memory", F.lit(0.0))
    joined = both.join(cluster_costs.select("cluster_id", "date", F.col("cost").alias("total")), ["cluster_id", "date"], "left")
    return joined.select(*on, (F.coalesce("total", F.lit(0.0)) * weight).alias("cost"))


def ns_allocation_chart(allocation: DataFrame) -> DataFrame:
    """(cluster_id, namespace, labels, costs): dates and costs as arrays in the order of the dates."""
    pairs = F.array_sort(F.collect_list(F.struct("date", "cost")))
    rows = allocation.groupBy("cluster_id", "namespace").agg(pairs.alias("p"))
    return rows.select("cluster_id", "namespace", F.col("p.date").alias("labels"), F.col("p.cost").alias("costs"))


def matching_rules(tagged: DataFrame, rules: DataFrame, rule_tags: str) -> DataFrame:
    """Rows of ``tagged`` (tags, any others) with each rule whose ``rule_tags`` are contained in their tags.

    Rules are met through their rarest tag (:mod:`costloom.operators.tagjoin`); a rule without tags matches nothing.
    Other columns of both sides are kept and must differ in name.
    """
    return containing(tagged, rules, rule_tags)


def apply_allocation_rules(base: DataFrame, scopes: DataFrame, rules: DataFrame, source_costs: DataFrame) -> DataFrame:
    """``base`` (scope_id, tags_key, date, cost) plus incoming and minus outgoing percentages of rules' source costs.

    ``rules`` has rule_id, source_tags, target_tags and percentage; ``source_costs`` has the daily
    costs of the root under each source tag set (tags_key, date, cost). Rules aren't chained. A rule
    whose tags are contained in the scope's applies; an empty rule side applies to none.
    """
    keyed = with_key(scopes).select(*SCOPE, "tags")
    side = rules.select("rule_id", "source_tags", "target_tags", "percentage", tags_key(F.col("source_tags")).alias("source_key"))

    def touched(tags: str, sign: float) -> DataFrame:
        return matching_rules(keyed, side, tags).select(*SCOPE, "source_key", (F.lit(sign) * F.col("percentage") / 100.0).alias("part"))

    parts = touched("target_tags", 1.0).union(touched("source_tags", -1.0))
    source = source_costs.select(F.col("tags_key").alias("source_key"), "date", F.col("cost").alias("source_cost"))
    moved = parts.join(source, "source_key").select(*SCOPE, "date", (F.col("part") * F.col("source_cost")).alias("cost"))
    return base.select(*SCOPE, "date", "cost").union(moved).groupBy(*SCOPE, "date").agg(F.sum("cost").alias("cost"))


class Chargeback:
    """Aggregated costs of scopes over one window, with the tables they need.

    Sums per entity and day, and namespaces' shares, are written once: several steps read them.
    """

    def __init__(self, entities: DataFrame, costs: DataFrame, kube_metrics: DataFrame, rules: DataFrame, tree: DataFrame, start: dt.date, end: dt.date, rate: float = 1.0):
        self.entities, self.costs, self.kube_metrics, self.rules, self.tree = entities, costs, kube_metrics, rules, tree
        self.start, self.end, self.rate = start, end, rate

    @functools.cached_property
    def per_entity(self) -> DataFrame:
        return durable(entity_daily(self.costs, self.start, self.end, self.rate), "entity-daily")

    def raw(self, scopes: DataFrame) -> DataFrame:
        """Billing costs alone."""
        sums = scope_sums(self.tree, self.entities, scopes, self.per_entity)
        return gap_filled(with_key(scopes).select(*SCOPE), sums, SCOPE, self.start, self.end, "cost")

    def ruled(self, base: DataFrame, scopes: DataFrame) -> DataFrame:
        """Costs after allocation rules."""
        return apply_allocation_rules(base, scopes, self.rules, self.source_costs)

    @functools.cached_property
    def source_costs(self) -> DataFrame:
        """The rules' source costs, written once."""
        sources = self.rules.where(F.size("source_tags") > 0).select(F.lit(0).cast("long").alias("scope_id"), F.col("source_tags").alias("tags"))
        sources = with_key(sources).dropDuplicates(["tags_key"]).select("scope_id", "tags")
        return durable(self.raw(sources), "source-costs")

    def shares(self) -> tuple[DataFrame, DataFrame]:
        """Namespace shares of processor and memory reservations."""
        return self._shares

    @functools.cached_property
    def _shares(self) -> tuple[DataFrame, DataFrame]:
        return tuple(durable(ns_metric_share(self.kube_metrics, self.entities, m, self.start, self.end), "shares") for m in ("cpu_requests_cores", "memory_requests_bytes"))

    def cluster_costs(self) -> DataFrame:
        """(cluster_id, date, cost): each cluster under its own cluster tag, with rules; written once."""
        return self._cluster_costs

    @functools.cached_property
    def _cluster_costs(self) -> DataFrame:
        clusters = self.entities.where("type = 'kubernetes_cluster'").select(F.col("id").alias("scope_id"), F.create_map(F.lit("cluster"), F.col("name")).alias("tags"))
        return durable(self.with_k8s(clusters).select(F.col("scope_id").alias("cluster_id"), "date", "cost"), "cluster-costs")

    def namespace_costs(self, scopes: DataFrame, cluster_costs: DataFrame) -> DataFrame:
        """Allocations of the namespaces that hold each scope's tags."""
        allocated = ns_allocation(*self.shares(), cluster_costs)
        return namespaces_for_tags(self.entities, scopes).join(allocated, ["cluster_id", "namespace"])

    def with_k8s(self, scopes: DataFrame) -> DataFrame:
        """Costs with tag-matched namespaces' shares of their untagged cluster's costs, and rules."""
        clusters = self.entities.where("type = 'kubernetes_cluster'").select(F.col("id").alias("scope_id"), F.create_map().cast("map<string,string>").alias("tags"))
        plain = self.raw(clusters).select(F.col("scope_id").alias("cluster_id"), "date", "cost")
        return self.summed(scopes, plain)

    def aggregated(self, scopes: DataFrame) -> DataFrame:
        """Costs with tag-matched namespaces' shares of :meth:`cluster_costs`, and rules; without tags billing costs alone."""
        return self.summed(scopes, self.cluster_costs())

    def summed(self, scopes: DataFrame, cluster_costs: DataFrame) -> DataFrame:
        shares = self.namespace_costs(scopes, cluster_costs).select(*SCOPE, "date", "cost")
        return self.ruled(self.raw(scopes).select(*SCOPE, "date", "cost").union(shares), scopes)

    def by_category(self, scopes: DataFrame) -> DataFrame:
        """Costs by category; a namespace is the category ``k8s:<name>``; of equal names the largest id stays."""
        costs = self.costs.withColumn("category", F.coalesce("category", F.lit("Other")))
        own = scope_sums(self.tree, self.entities, scopes, entity_daily(costs, self.start, self.end, self.rate, "category"), "category")
        shared = self.namespace_costs(scopes, self.cluster_costs())
        shared = shared.groupBy(*SCOPE, "date", F.concat(F.lit("k8s:"), F.col("namespace")).alias("category")).agg(F.max_by("cost", "ns_id").alias("cost"))
        return own.unionByName(shared)

    def by_tag(self, scopes: DataFrame, key: str) -> DataFrame:
        """Costs by a tag's values, namespaces under their own value."""
        named = self.entities.select(F.col("id").alias("entity_id"), F.coalesce(F.try_element_at("tags", F.lit(key)), F.lit("Unrecognized")).alias("tag_value"))
        own = scope_sums(self.tree, self.entities, scopes, self.per_entity.join(named, "entity_id"), "tag_value")
        value = F.coalesce(F.try_element_at("ns_tags", F.lit(key)), F.lit("Unrecognized")).alias("tag_value")
        shared = self.namespace_costs(scopes, self.cluster_costs()).select(*SCOPE, "date", value, "cost")
        return own.unionByName(shared).groupBy(*SCOPE, "date", "tag_value").agg(F.sum("cost").alias("cost"))


def topn_other(breakdown: DataFrame, keys: list[str], category: str = "category", n: int = 5) -> DataFrame:
    """A breakdown (keys, date, category, cost) whose categories beyond the ``n`` dearest are ``other``.

    Ties go by name; an existing ``other`` takes the rest in. Up to ``n`` categories stay as they are.
    """
    totals = breakdown.groupBy(*keys, category).agg(F.sum("cost").alias("__total"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__total"), category))
    named = totals.select(*keys, category, F.when(place <= n, F.col(category)).otherwise("other").alias("__to"))
    return breakdown.join(named, [*keys, category]).groupBy(*keys, "date", F.col("__to").alias(category)).agg(F.sum("cost").alias("cost"))


def month_report(daily: DataFrame, forecasts: DataFrame, keys: list[str], cutoff: dt.date, thresholds: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """One row per key and day: actual and cumulative costs up to the cutoff, then the forecast's running sum.

    ``daily`` has every day of the month; ``forecasts`` has (keys, date, predicted). Predictions
    below 0 count 0. On the cutoff day the forecast line starts from the actual sum. ``thresholds``
    has some of the keys, date and threshold: days up to the cutoff get their anomaly entry from it.
    ``limits`` has some of the keys and limit_amount. ``projected_total`` is the month's whole sum.
    """
    actual = F.col("date") <= F.lit(cutoff)
    rows = daily.join(forecasts.select(*keys, "date", "predicted"), [*keys, "date"], "left")
    value = F.when(actual, F.col("cost")).otherwise(F.greatest(F.coalesce("predicted", F.lit(0.0)), F.lit(0.0)))
    month = W.partitionBy(*keys).orderBy("date")
    running = F.sum("__v").over(month.rowsBetween(W.unboundedPreceding, 0))
    total = F.last("__sum").over(month.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("__v", value).withColumn("__sum", running).withColumn("projected_total", total)
    rows = with_limits(rows, thresholds, [*keys, "date"], "threshold")
    rows = with_limits(rows, limits, keys, "limit_amount")
    entry = anomaly_entry(F.when(actual, F.col("cost")), F.col("threshold"))
    return rows.select(
        *keys, "date",
        F.when(actual, F.col("cost")).alias("actual_daily"),
        F.when(actual, F.col("__sum")).alias("actual_cumulative"),
        F.when(F.col("date") >= F.lit(cutoff), F.col("__sum")).alias("forecast_cumulative"),
        entry["is_anomaly"].alias("is_anomaly"), entry["delta"].alias("anomaly_delta"),
        "projected_total", F.col("limit_amount").alias("budget"),
    )


def with_limits(rows: DataFrame, limits: DataFrame | None, keys: list[str], column: str) -> DataFrame:
    """Rows with a column of ``limits``, matched by those of ``keys`` that it has; null without one."""
    if limits is None:
        return rows.withColumn(column, F.lit(None).cast("double"))
    on = [k for k in keys if k in limits.columns]
    return rows.join(limits.select(*on, column), on, "left")


def month_breakdown(breakdown: DataFrame, keys: list[str], start: dt.date, end: dt.date, cutoff: dt.date, n: int = 5) -> DataFrame:
    """(keys, category, date, cost) on every day of the month: 0 on days without costs, null after the cutoff; the dearest ``n`` categories and ``other``."""
    top = topn_other(breakdown.where(F.col("date") <= F.lit(cutoff)), keys, n=n)
    on = [*keys, "category"]
    full = gap_filled(top.select(*on).distinct(), top, on, start, end, "cost")
    return full.select(*on, "date", F.when(F.col("date") <= F.lit(cutoff), F.col("cost")).alias("cost"))


def rule_budget(rules: DataFrame) -> DataFrame:
    """(source_key, total, valid) per identical source tag set; more than 100.001 percent isn't valid."""
    sums = rules.groupBy(tags_key(F.col("source_tags")).alias("source_key")).agg(F.sum("percentage").alias("total"))
    return sums.withColumn("valid", F.col("total") <= 100.001)


def accept_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rules in order of rule_id, with ``accepted``: whether the source's total stays within 100.001 percent."""
    have = rule_budget(rules).select("source_key", F.col("total").alias("have"))
    keyed = new.withColumn("source_key", tags_key(F.col("source_tags")))
    running = F.sum("percentage").over(W.partitionBy("source_key").orderBy("rule_id").rowsBetween(W.unboundedPreceding, 0))
    return keyed.join(have, "source_key", "left").withColumn("accepted", F.coalesce("have", F.lit(0.0)) + running <= 100.001).drop("have")


def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Allocation rules with the accepted ones of ``new`` added."""
    return rules.unionByName(accept_rules(rules, new).where("accepted").select(*rules.columns))


def delete_rules(rules: DataFrame, gone: DataFrame, key: str = "rule_id") -> DataFrame:
    """Rules (of allocation or for hidden tags) without those whose ids are in ``gone``; unknown ids change nothing."""
    return rules.join(gone.select(key), key, "left_anti")


def tag_filters(rules: DataFrame) -> DataFrame:
    """(rule_id, pattern) of rules (rule_id, patterns), the newest first; a rule's first pattern counts, empty without one."""
    return rules.select("rule_id", F.coalesce(F.get("patterns", F.lit(0)), F.lit("")).alias("pattern")).orderBy(F.desc("rule_id"))
