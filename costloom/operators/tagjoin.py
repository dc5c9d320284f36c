"""Containment joins of tag maps through each rule's rarest tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.functions.tags import tags_contain

#: Rows of one tag that a task should get.
HOT_ROWS = 50_000
_KEY = ["__k", "__v"]


def candidates(tagged: DataFrame, rules: DataFrame, rule_tags: str, tags: str = "tags", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of ``tagged`` with each rule whose rarest tag they hold.

    How many rows hold each tag of the rules is counted first, by an aggregation that combines before it
    shuffles. A rule is then looked up by the one of its tags that fewest rows hold; a rule with a tag that no row holds
    is left out. Rows of a tag with more than ``hot_rows`` of them are dealt over as many parts as it takes. So
    a tag that all rows hold is a key only for rules that have no other.
    """
    rules = rules.where(F.size(rule_tags) > 0)
    entries = rules.select(F.explode(F.map_entries(rule_tags)).alias("e")).select(F.col("e.key").alias("__k"), F.col("e.value").alias("__v")).distinct()
    pairs = tagged.select(F.explode(tags).alias(*_KEY))
    counts = pairs.join(entries, _KEY, "left_semi").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("__n"))
    numbered = rules.withColumn("__rule", F.xxhash64(F.to_json(rule_tags)))
    # the rarest tag of each distinct set of tags
    sets = numbered.select("__rule", rule_tags).dropDuplicates(["__rule"])
    each = sets.select("__rule", F.size(rule_tags).alias("__size"), F.explode(F.map_entries(rule_tags)).alias("e")).select("__rule", "__size", F.col("e.key").alias("__k"), F.col("e.value").alias("__v"))
    known = each.join(counts, _KEY).groupBy("__rule").agg(F.count(F.lit(1)).alias("__held"), F.max("__size").alias("__size"), F.min(F.struct("__n", *_KEY)).alias("__rarest"))
    parts = F.ceil(F.col("__rarest.__n") / hot_rows).cast("int")
    chosen = known.where("__held = __size").select("__rule", F.col("__rarest.__k").alias("__k"), F.col("__rarest.__v").alias("__v"), parts.alias("__parts"))
    looked = chosen.select(*_KEY, "__parts").distinct()
    rows = tagged.select("*", F.explode(tags).alias(*_KEY)).join(looked, _KEY)
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(F.to_json(F.struct(*tagged.columns))), F.col("__parts")).cast("int")).drop("__parts")
    asked = numbered.join(chosen, "__rule").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts", "__rule")
    return rows.join(asked, [*_KEY, "__part"]).drop(*_KEY, "__part")


def containing(tagged: DataFrame, rules: DataFrame, rule_tags: str, tags: str = "tags", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of ``tagged`` with each rule whose tags are all among theirs; rules without tags match nothing.

    Columns of both sides are kept and must differ in name. Repeated rows and rules all match.
    """
    clash = {c for c in tagged.columns if c in rules.columns}
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    return candidates(tagged, rules, rule_tags, tags, hot_rows).where(tags_contain(F.col(tags), F.col(rule_tags)))
