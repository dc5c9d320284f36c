"""URL filtering as a sort-merge range join of URLs with host-and-path rules.

A URL's key is its host with the labels reversed, each followed by a dot (``com.example.www.``). A
rule's host turns into a key in the same way and stands for the interval of keys that start with
it, so rules of nested hosts are nested intervals. URLs and rules are merged in key order and swept
once; a stack holds the rules whose intervals are open. The longest fitting rule (host and path
together, then the longer host) wins.

Rules are cut into ranges of about ``rules_per_range`` by key; every range also gets the rules that
are open at its start. A range's URLs are counted and dealt over as many slices as they need, so that
a host with a third of all rows is swept by many tasks, and a rule is sent to the slices of its own
range only: with few rules a range beside many URLs a slice, rules are a small part of what is
shuffled, at any number of either. Only the range bounds go through the driver, one key for
``rules_per_range`` rules.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import durable, frugal

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels of a host in reverse, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


class OpenRules:
    """The stack of rules whose key intervals hold the sweep's position."""

    def __init__(self):
        self.stack: list[tuple[str, dict, list]] = []

    def move(self, key: str) -> None:
        """Close the intervals that end before ``key``."""
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        kept = paths.get(path)
        # equal rules with different verdicts: block wins
        if kept is None or verdict == "block":
            paths[path] = (rule, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def match(self, key: str, path: str) -> tuple[str, str] | None:
        self.move(key)
        best = None
        for _, paths, lengths in self.stack:
            for n in lengths:
                found = paths.get(path[:n]) if n <= len(path) else None
                if found:
                    if best is None or len(found[0]) >= len(best[0]):
                        best = found
                    break
        return best


def range_bounds(rule_rows: DataFrame, rules_per_range: int) -> list[str]:
    """Keys that cut the rules (key, path) into ranges of about ``rules_per_range``, from a sample of 20 rules a range."""
    n_rules = rule_rows.count()
    ranges = -(-n_rules // rules_per_range)
    if ranges < 2:
        return []
    share = min(1.0, 20.0 * ranges / n_rules)
    some = sorted(r["key"] for r in rule_rows.where(F.xxhash64("key", "path").cast("double") <= share * 2.0**64 - 2.0**63).select("key").collect())
    step = max(1, len(some) // ranges)
    return sorted(set(some[step::step]))


def spread_rules(rule_rows: DataFrame, range_of, slices: DataFrame, bounds: list[str]) -> DataFrame:
    """``rule_rows`` once for every slice of every range that they are needed in: their own, and those whose lower bound lies in their interval."""
    needed = rule_rows.select("*", range_of(F.col("key")).alias("range"))
    if bounds:
        starts = rule_rows.sparkSession.createDataFrame([(b, k + 1) for k, b in enumerate(bounds)], "bound string, range int")
        # each bound lies in the intervals of its own prefixes only: an equi-join
        labels = F.split(F.expr("substring(bound, 1, length(bound) - 1)"), "\\.")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
        opened = starts.select("range", F.explode(prefixes).alias("key"))
        needed = needed.unionByName(rule_rows.join(opened, "key").select(*needed.columns)).distinct()
    return needed.join(slices, "range").select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).drop("slices")


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    carry: list[str],
    default: str = "allow",
    rules_per_range: int = 20_000,
    urls_per_slice: int = 200_000,
) -> DataFrame:
    """``carry`` columns plus ``host``, ``path``, ``rule`` and ``verdict`` for every row of ``pages`` (url).

    ``rules`` has host, path and verdict; rows with a null are left out, repeated ones count once.
    URLs that no rule fits, null URLs and URLs without ``://`` get a null rule and the ``default``
    verdict. Repeated rows are judged alike and kept; empty tables give no rows, or the default
    everywhere. Carried columns may not be called ``host``, ``path``, ``rule`` or ``verdict``. Rules of
    one host stay in one range, however many they are.
    """
    spark = pages.sparkSession
    if clash := {"host", "path", "rule", "verdict"} & set(carry):
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    host, path = host_and_path(F.col("url"))
    # numbered where they are read, before any shuffle: rows equal in all columns are dealt out too, and a task that is run again numbers alike
    rows = pages.select(*carry, host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("__row"))
    rule_rows = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct()
    rule_rows = rule_rows.withColumn("key", host_key(F.col("host")))
    bounds = range_bounds(rule_rows, rules_per_range)
    if bounds:
        rule_rows = durable(rule_rows, "url-rules")
        shared = spark.sparkContext.broadcast(np.array(bounds, object))

        @F.pandas_udf("int")
        def place(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(shared.value, keys.to_numpy(object), "right").astype(np.int32))

        def range_of(key: Column) -> Column:
            return place(key)
    else:

        def range_of(key: Column) -> Column:
            return F.lit(0)

    keyed = rows.withColumn("key", host_key(F.col("host"))).withColumn("range", range_of(F.col("key")))
    # one row a range; large tables are swept in as many slices as there are shuffle partitions at least
    counts = keyed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    at_once = max(1, min(urls_per_slice, -(-total // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    slices = counts.select("range", F.ceil(F.col("n") / at_once).cast("int").alias("slices"))
    if bounds:
        slices = durable(slices, "url-slices")
        dealt = keyed.join(slices, "range")
    else:
        dealt = keyed.withColumn("slices", F.lit(max(1, -(-total // at_once))))
        slices = spark.range(1).select(F.lit(0).alias("range"), F.lit(max(1, -(-total // at_once))).alias("slices"))
    shapes = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*carry).schema.fields)
    held = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    salt = F.pmod(F.xxhash64("__row"), F.col("slices")).cast("int")
    swept = dealt.select("range", salt.alias("slice"), "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"), held.alias("held"))
    opened = spread_rules(rule_rows, range_of, slices, bounds).select("range", "slice", "key", F.lit(0).alias("kind"), "host", "path", "verdict", F.lit(None).cast(swept.schema["held"].dataType).alias("held"))
    order = swept.unionByName(opened).repartition("range", "slice").sortWithinPartitions("range", "slice", "key", "kind", "path")

    def sweep(batches):
        at, rules = None, OpenRules()
        for batch in batches:
            keep, found, verdicts = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("range", "slice", "key", "kind", "host", "path", "verdict")]
            for i, (part, piece, key, kind, host, path, verdict) in enumerate(zip(*columns)):
                if at != (part, piece):
                    at, rules = (part, piece), OpenRules()
                if kind == 0:
                    rules.open(key, path, host + path, verdict)
                else:
                    best = rules.match(key, path)
                    keep.append(i)
                    found.append(best and best[0])
                    verdicts.append(best[1] if best else default)
            kept = batch.take(pa.array(keep, pa.int64()))
            fields = kept.column("held").flatten()[: len(carry)]
            yield pa.RecordBatch.from_arrays([*fields, kept.column("host"), kept.column("path"), pa.array(found, pa.string()), pa.array(verdicts, pa.string())], [*carry, "host", "path", "rule", "verdict"])

    return order.mapInArrow(frugal(sweep), f"{shapes}{', ' if carry else ''}host string, path string, rule string, verdict string")
