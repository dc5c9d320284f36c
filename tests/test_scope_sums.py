"""Sums by ancestor and tags against those over the scopes' members."""

import datetime as dt

from costloom.operators import costs as C
from costloom.operators import hierarchy as H


def test_sums_climb_the_tree_without_members(spark):
    day = dt.date(2024, 1, 1)
    nodes = spark.createDataFrame([(0, None, {}), (1, 0, {"a": "x"}), (2, 0, None), (3, 1, {"a": "x", "b": "y"}), (4, 1, {"a": "z"}), (5, 3, {"b": "y", "a": "x"})], "id long, parent_id long, tags map<string,string>")
    rows = spark.createDataFrame([(i, day, float(10**i)) for i in range(6)], "entity_id long, date date, cost double")
    scopes = spark.createDataFrame([(s, t) for s in (0, 1, 3) for t in ({}, {"a": "x"}, {"b": "y", "a": "x"}, {"c": "w"})], "scope_id long, tags map<string,string>")
    tree = H.closure(nodes)
    over = rows.join(H.scope_entities(tree, nodes, scopes), "entity_id").groupBy("scope_id", "tags_key").sum("cost")
    got = C.scope_sums(tree, nodes, scopes, rows)
    want = {(r[0], r[1]): r[2] for r in over.collect()}
    assert {(r["scope_id"], r["tags_key"]): r["cost"] for r in got.collect()} == want and len(want) == 9
