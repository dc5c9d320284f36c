"""The entity tree: closure, scopes, explorer queries and tag statistics. All answer many scopes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions.tables import durable
from costloom.functions.tags import glob_to_regex, tags_contain, tags_key
from costloom.operators.tagjoin import containing
from costloom.operators.upsert import current, expire, publish, snapshots


def closure(entities: DataFrame, pruned: Column | None = None) -> DataFrame:
    """(ancestor, descendant, depth, path) of the tree, each node its own ancestor at depth 0.

    Steps double: from all pairs less than n levels apart and those exactly n apart come all pairs
    less than 2n apart. So a tree of depth d takes about log2(d) joins, with no limit of depth; a
    cycle is an error. ``pruned`` is a condition on a child: where it doesn't hold, the child and all
    below it are left out under every ancestor. The result is a written table.
    """
    kept = F.lit(True) if pruned is None else F.coalesce(pruned, F.lit(False))
    tree = durable(entities.select("id", F.when(kept, F.col("parent_id")).alias("parent_id")), "tree")
    near = tree.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    # the parents that are entities themselves
    apart = tree.where("parent_id IS NOT NULL").join(tree.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    apart = apart.select(F.col("parent_id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(1).alias("depth"), F.array("parent_id", "id").alias("path"))
    return grown(near, apart)


def grown(near: DataFrame, apart: DataFrame) -> DataFrame:
    """All chains of the pairs ``apart``, with ``near``, the chains of no pair; both as :func:`closure`'s rows."""
    n = 1
    while True:
        found = apart.agg(F.count(F.lit(1)).alias("n"), F.max((F.size(F.array_distinct("path")) < F.size("path")).cast("int")).alias("cycle")).first()
        if not found["n"]:
            return near if n >= 4 else durable(near, "closure")
        if found["cycle"]:
            raise ValueError("the tree of entities has a cycle")
        near, apart, n = near.union(joined(near, apart)), joined(apart, apart), 2 * n
        if n >= 4:
            near, apart = durable(near, "closure"), durable(apart, "closure")


def moved_closure(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """The closure after ``changes`` (id, parent_id): nodes that are new or hang elsewhere; a null parent makes a root.

    What doesn't lie below a changed node stays as it is. Below one, the pairs that lead over a changed node's old
    place go, and each changed node's subtree meets its new ancestors: the work is subtrees times
    ancestors, not the tree. A parent that is no node counts as none. An id may be in ``changes`` once. A cycle is
    an error, as in :func:`closure`.
    """
    changes = durable(changes.select("id", "parent_id"), "moved")
    moved = changes.select(F.col("id").alias("__m"))
    below = durable(tree.join(moved, F.col("ancestor") == F.col("__m"), "left_semi").select("descendant").distinct(), "below")
    stays = tree.join(below, "descendant", "left_anti").select("ancestor", "descendant", "depth", "path")
    touched = tree.join(below, "descendant", "left_semi").select("ancestor", "descendant", "depth", "path")
    over = touched.select("ancestor", "descendant", F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("__m")).join(moved, "__m", "left_semi").select("ancestor", "descendant").distinct()
    own = changes.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    new = own.join(tree.where("depth = 0").select("ancestor"), "ancestor", "left_anti")
    inner = durable(touched.join(over, ["ancestor", "descendant"], "left_anti").select(*tree.columns).unionByName(new), "inner")
    left = stays.select(*tree.columns).unionByName(inner)
    # each changed node under all that its new parent kept above it
    up = left.join(changes.where("parent_id IS NOT NULL"), F.col("descendant") == F.col("parent_id"))
    up = durable(up.select("ancestor", F.col("id").alias("descendant"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("id")).alias("path")), "up")
    # and chains of changed nodes under each other
    chains = grown(own, up.join(moved, F.col("ancestor") == F.col("__m"), "left_semi"))
    above = joined(up, chains)
    return left.unionByName(joined(above, inner.join(moved, F.col("ancestor") == F.col("__m"), "left_semi")))


def changed_parents(entities: DataFrame, known: DataFrame) -> DataFrame:
    """(id, parent_id) of the nodes that ``known`` (id, parent_id) lacks or has elsewhere."""
    before = known.select("id", F.col("parent_id").alias("__old"), F.lit(True).alias("__known"))
    now = entities.select("id", "parent_id").join(before, "id", "left")
    return now.where(F.col("__known").isNull() | ~F.col("parent_id").eqNullSafe(F.col("__old"))).select("id", "parent_id")


def stored_closure(entities: DataFrame, folder: str) -> DataFrame:
    """The closure of ``entities`` (id, parent_id) that ``folder`` stores, brought up to date.

    The folder holds snapshots of the pairs and of the tree that they belong to. Nodes that are new or moved since then are
    worked in by :func:`moved_closure` and a new snapshot is published; with none, nothing is written. Nodes that are gone make
    a rebuild, as does an empty folder. One writer at a time; readers see the last whole snapshot; the one before stays for those that have it open, and older ones go.
    """
    spark = entities.sparkSession
    own = entities.select("id", "parent_id")
    held = snapshots(spark, f"{folder}/tree")
    if held and held == snapshots(spark, f"{folder}/pairs"):
        known = current(spark, f"{folder}/tree")
        if known.join(own, "id", "left_anti").isEmpty():
            changes = changed_parents(own, known)
            if changes.isEmpty():
                return current(spark, f"{folder}/pairs")
            pairs = moved_closure(current(spark, f"{folder}/pairs"), changes)
        else:
            pairs = closure(own)
    else:
        pairs = closure(own)
    publish(pairs, f"{folder}/pairs")
    publish(own, f"{folder}/tree")
    for part in ("pairs", "tree"):
        expire(spark, f"{folder}/{part}")
    return current(spark, f"{folder}/pairs")


def joined(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of ``upper`` continued by the pairs of ``lower`` that begin where they end."""
    below = lower.select(F.col("ancestor").alias("__at"), F.col("descendant").alias("__end"), F.col("depth").alias("__depth"), F.col("path").alias("__path"))
    path = F.concat("path", F.slice("__path", F.lit(2), F.size("__path")))
    return upper.join(below, F.col("descendant") == F.col("__at")).select("ancestor", F.col("__end").alias("descendant"), (F.col("depth") + F.col("__depth")).alias("depth"), path.alias("path"))


def with_key(scopes: DataFrame) -> DataFrame:
    """Scopes (scope_id, tags) with their canonical tags_key."""
    return scopes.withColumn("tags_key", tags_key(F.col("tags")))


def scope_entities(tree: DataFrame, entities: DataFrame, scopes: DataFrame, include_self: bool = False) -> DataFrame:
    """(scope_id, tags_key, entity_id): descendants of each scope that hold all its tags.

    The scope's own node is left out unless asked for; tags aren't inherited.
    """
    below = tree.where(F.col("depth") >= (0 if include_self else 1)).select(F.col("ancestor").alias("scope_id"), F.col("descendant").alias("entity_id"))
    own = entities.select(F.col("id").alias("entity_id"), F.col("tags").alias("__tags"))
    found = with_key(scopes).select("scope_id", "tags", "tags_key").join(below, "scope_id").join(own, "entity_id")
    return found.where(tags_contain(F.col("__tags"), F.col("tags"))).select("scope_id", "tags_key", "entity_id")


def has_children(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """``nodes`` (id, ...) with a flag for entities below them."""
    parents = entities.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.lit(True).alias("has_children")).distinct()
    return nodes.join(parents, "id", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def entity_roots(entities: DataFrame) -> DataFrame:
    """Entities directly below the virtual root."""
    return has_children(entities.where("parent_id = 0").select("id", "name", "type", "provider"), entities)


def entity_children(entities: DataFrame, parents: DataFrame) -> DataFrame:
    """Direct children of each of ``parents`` (parent_id)."""
    return has_children(entities.join(parents, "parent_id").select("parent_id", "id", "name", "type"), entities)


def entity_chain(tree: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, position, id, name, type) from the root's child down to each of ``nodes`` (node)."""
    up = tree.where("ancestor <> 0").join(nodes, F.col("descendant") == F.col("node")).select("node", F.col("ancestor").alias("id"), "depth")
    named = up.join(entities.select("id", "name", "type"), "id")
    top = named.groupBy("node").agg(F.max("depth").alias("top"))
    return named.join(top, "node").select("node", (F.col("top") - F.col("depth")).alias("position"), "id", "name", "type")


def tag_key_top(entities: DataFrame, limit: int = 15) -> DataFrame:
    """The most frequent tag keys."""
    keys = entities.select(F.explode(F.map_keys("tags")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(limit)


def scoped_tag_key_top(tree: DataFrame, entities: DataFrame, scopes: DataFrame, patterns: list[str], limit: int = 15) -> DataFrame:
    """(scope_id, key, n, total): the most frequent tag keys per subtree, the scope node included.

    ``tree`` should be pruned to recent entities; keys that fit a glob pattern are left out.
    """
    inside = tree.join(scopes.select("scope_id").distinct(), F.col("ancestor") == F.col("scope_id")).select("scope_id", F.col("descendant").alias("id"))
    rows = inside.join(entities.select("id", "tags"), "id")
    total = rows.groupBy("scope_id").agg(F.count(F.lit(1)).alias("total"))
    keys = rows.select("scope_id", F.explode(F.map_keys("tags")).alias("key"))
    for p in patterns:
        keys = keys.where(~F.rlike("key", glob_to_regex(F.lit(p))))
    counts = keys.groupBy("scope_id", "key").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.groupBy("scope_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "key"))), 1, limit).alias("top"))
    return ranked.join(total, "scope_id").select("scope_id", F.explode("top").alias("x"), "total").select("scope_id", "x.key", (-F.col("x.m")).alias("n"), "total")


def scoped_children(entities: DataFrame, parents: DataFrame, recent: Column) -> DataFrame:
    """Direct children that were updated recently, or are the root."""
    return has_children(entities.where(recent | (F.col("id") == 0)).join(parents, "parent_id").select("parent_id", "id", "name", "type"), entities)


def scoped_tag_values(tree: DataFrame, entities: DataFrame, scopes: DataFrame, key: str) -> DataFrame:
    """(scope_id, value, n): how often each value of a tag key occurs in each subtree."""
    inside = tree.join(scopes.select("scope_id").distinct(), F.col("ancestor") == F.col("scope_id")).select("scope_id", F.col("descendant").alias("id"))
    rows = inside.join(entities.select("id", F.try_element_at("tags", F.lit(key)).alias("value")), "id").where("value IS NOT NULL")
    return rows.groupBy("scope_id", "value").agg(F.count(F.lit(1)).alias("n"))


def scoped_dynamic_items(tree: DataFrame, entities: DataFrame, scopes: DataFrame, metered: DataFrame) -> DataFrame:
    """Entities below each scope that hold its tags, with all entities on the way to them.

    has_children looks at the shown entities only; has_metrics is set for direct children of the
    scope whose id is in ``metered`` (entity_id).
    """
    keyed = with_key(scopes)
    below = tree.join(keyed.select("scope_id", "tags", "tags_key"), F.col("ancestor") == F.col("scope_id"))
    own = entities.select(F.col("id").alias("descendant"), F.col("tags").alias("__tags"))
    hits = below.join(own, "descendant").where(tags_contain(F.col("__tags"), F.col("tags")))
    shown = hits.select("scope_id", "tags_key", F.explode("path").alias("id")).where("id <> scope_id").distinct()
    shown = shown.join(entities.select("id", "name", "type", "parent_id"), "id")
    parents = shown.select("scope_id", "tags_key", F.col("parent_id").alias("id"), F.lit(True).alias("has_children")).distinct()
    out = shown.join(parents, ["scope_id", "tags_key", "id"], "left").join(metered.select(F.col("entity_id").alias("id"), F.lit(True).alias("__m")).distinct(), "id", "left")
    return out.select("scope_id", "tags_key", "id", "name", "type", "parent_id", F.coalesce("has_children", F.lit(False)).alias("has_children"), ((F.col("parent_id") == F.col("scope_id")) & F.col("__m").isNotNull()).alias("has_metrics"))


def namespaces_for_tags(entities: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope_id, tags_key, ns_id, cluster_id, namespace, ns_tags) of namespaces in any cluster that hold a scope's tags.

    Scopes without tags have none. Scopes with equal tags are one rule, met through its rarest tag.
    """
    keyed = with_key(scopes).where(F.size("tags") > 0)
    rules = keyed.select("tags_key", F.col("tags").alias("wanted")).dropDuplicates(["tags_key"])
    spaces = entities.where("type = 'kubernetes_namespace'").select(F.col("id").alias("ns_id"), F.col("parent_id").alias("cluster_id"), F.col("name").alias("namespace"), F.col("tags").alias("ns_tags"))
    found = containing(spaces, rules, "wanted", "ns_tags").drop("wanted")
    return keyed.select("scope_id", "tags_key").join(found, "tags_key").select("scope_id", "tags_key", "ns_id", "cluster_id", "namespace", "ns_tags")
