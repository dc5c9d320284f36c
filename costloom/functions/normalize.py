"""Normalisation of provider, operating system, metric names, values and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, *parts: str) -> Column:
    """Whether a text holds one of the parts."""
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def provider_of(name: Column) -> Column:
    """aws, azure or unknown, from a billing export's provider name."""
    text = F.lower(F.coalesce(name, F.lit("")))
    return F.when(contains_any(text, "aws", "amazon"), "aws").when(contains_any(text, "microsoft", "azure"), "azure").otherwise("unknown")


def account_of(sub_account: Column) -> Column:
    """The last path segment of a subscription path, else the account as it is."""
    return F.when(F.lower(sub_account).contains("subscriptions/"), F.element_at(F.split(sub_account, "/"), -1)).otherwise(sub_account)


def usd_to_eur(cost: Column, currency: Column, rate: Column | float) -> Column:
    """A cost in EUR; only USD is converted."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    return cost * F.when(currency == "USD", rate).otherwise(F.lit(1.0))


def _named_os(text: Column) -> Column:
    return F.when(contains_any(text, "red hat", "redhat", "rhel"), "RHEL").when(contains_any(text, "suse", "sles"), "SUSE")


def os_of_price_name(name: Column) -> Column:
    """Operating system from a price list's product or system name; Linux if unnamed."""
    text = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(_named_os(text), F.when(text.contains("windows"), "Windows"), F.lit("Linux"))


def os_of_platform(details: Column, platform: Column) -> Column:
    """Operating system from platform details, else from the platform."""
    text = F.lower(F.coalesce(details, F.lit("")))
    known = F.coalesce(_named_os(text), F.when(text.contains("windows"), "Windows"), F.when(text.contains("linux/unix"), "Linux"))
    return F.coalesce(known, F.when(F.lower(platform) == "windows", "Windows"), F.lit("Linux"))


def os_of_image(publisher: Column, offer: Column, disk_os: Column) -> Column:
    """Operating system from an image's publisher and offer, else from the disk."""
    publisher, offer = F.lower(F.coalesce(publisher, F.lit(""))), F.lower(F.coalesce(offer, F.lit("")))
    named = F.when(publisher.contains("redhat") | offer.contains("rhel"), "RHEL").when(publisher.contains("suse") | offer.contains("sles"), "SUSE")
    return F.coalesce(named, F.when(F.lower(disk_os) == "windows", "Windows"), F.lit("Linux"))


def arch_of_size(name: Column) -> Column:
    """arm64 if the letters between the core count and ``_`` or the end hold a p, else x86_64."""
    letters = F.regexp_extract(F.lower(name), "\\d+([a-z]+)(_|$)", 1)
    return F.when(letters.contains("p"), "arm64").otherwise("x86_64")


def unified_metric(name: Column, resource: Column | None = None) -> Column:
    """A metric name without provider and resource, in lower case with underscores."""
    text = F.translate(F.lower(name), "- ", "__")
    return F.regexp_replace(F.regexp_replace(text, "^[^_]*_", ""), "^[^_]*_", "")


#: Metrics that need more than their raw value (fixed values): name, factor per second of the period.
RATE_PER_SECOND = {
    "aws_ec2_disk_read_ops_avg": 1.0,
    "aws_ec2_disk_write_ops_avg": 1.0,
    "aws_ec2_disk_read_bytes_avg": 1.0,
    "aws_ec2_disk_write_bytes_avg": 1.0,
    "azure_vm_disk_read_bytes_avg": 1.0,
    "azure_vm_disk_write_bytes_avg": 1.0,
    "aws_ec2_net_in_avg": 8.0,
    "aws_ec2_net_out_avg": 8.0,
    "azure_vm_net_in_avg": 8.0,
    "azure_vm_net_out_avg": 8.0,
}


def rate_transformed(name: Column, value: Column, period_seconds: Column) -> Column:
    """Totals per period as rates per second (bytes of network traffic as bits); free memory as used."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in RATE_PER_SECOND.items() for x in kv]), name)
    rate = F.when(period_seconds > 0, value * factor / period_seconds).otherwise(0.0)
    return F.when(factor.isNotNull(), rate).when(name == "azure_vm_mem_used_avg", 100.0 - value).otherwise(value)


def first_value(average: Column, maximum: Column, minimum: Column, total: Column, count: Column) -> Column:
    """The first statistic that a data point has, else 0."""
    return F.coalesce(average, maximum, minimum, total, count, F.lit(0.0))


def vm_extras(os_name: Column, instance_type: Column) -> Column:
    """Lower-cased system and type of a machine as a map."""
    return F.create_map(F.lit("normalized_os"), F.lower(os_name), F.lit("instance_type"), F.lower(F.coalesce(instance_type, F.lit("unknown"))))


def key_value_tags(tags: Column) -> Column:
    """A map from an array of (Key, Value) structs; of repeated keys the last stays."""
    names = F.array_distinct(F.transform(tags, lambda t: t["Key"]))
    last = F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(tags, lambda t: t["Key"] == k), -1)["Value"].alias("value")))
    return F.map_from_entries(last)


def meta_hash(*keys: Column) -> Column:
    """A hash of canonical tag texts, to see whether an entity's metadata changed."""
    return F.md5(F.concat_ws("|", *keys).cast("binary"))


def _units(value: Column, divisor: float, unit: str, digits: int) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.bround(value / divisor, digits)), F.lit(unit))


def humanize_memory(text: Column) -> Column:
    """A byte count as Gi, Mi, Ki or B; ``-`` for missing values; other text as it is."""
    n = text.try_cast("double")
    shown = F.when(n >= 2.0**30, _units(n, 2.0**30, " Gi", 2)).when(n >= 2.0**20, _units(n, 2.0**20, " Mi", 0)).when(n >= 1024, _units(n, 1024.0, " Ki", 0)).otherwise(_units(n, 1.0, " B", 0))
    return F.when(F.coalesce(text, F.lit("")).isin("", "None"), "-").when(n.isNull(), text).otherwise(shown)


def humanize_cpu(text: Column) -> Column:
    """A core count as millicores below one core; ``-`` for missing values; other text as it is."""
    n = text.try_cast("double")
    shown = F.when(n < 1, _units(n * 1000, 1.0, "m", 0)).otherwise(_units(n, 1.0, "", 2))
    return F.when(F.coalesce(text, F.lit("")).isin("", "None"), "-").when(n.isNull(), text).otherwise(shown)
