"""Tag maps: lookup, containment, merge, canonical keys and glob patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags_key(tags: Column) -> Column:
    """A canonical text of a tag map, for grouping, joining and uniqueness; null counts as empty."""
    pairs = F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["key"], F.lit('":"'), p["value"], F.lit('"'))), ","), F.lit("}"))


def tags_contain(tags: Column, wanted: Column) -> Column:
    """Whether every pair of ``wanted`` is in ``tags``; an empty ``wanted`` is contained in all."""
    return F.forall(F.map_entries(wanted), lambda p: F.try_element_at(tags, p["key"]).eqNullSafe(p["value"]))


def tags_match(tags: Column, rule: Column) -> Column:
    """Containment, but an empty rule matches nothing."""
    return (F.size(rule) > 0) & tags_contain(tags, rule)


def tags_merge(old: Column, new: Column) -> Column:
    """All pairs of both maps; on a common key the new value stays."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def glob_to_regex(pattern: Column) -> Column:
    """An anchored regular expression for a pattern in which ``*`` stands for any text."""
    return F.concat(F.lit("^\\Q"), F.replace(pattern, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))


def glob_to_like(pattern: Column) -> Column:
    """A LIKE pattern for a pattern in which ``*`` stands for any text."""
    return F.replace(pattern, F.lit("*"), F.lit("%"))
