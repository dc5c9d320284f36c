"""Registered queries on the hierarchy, costs and chargeback."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from costloom.functions.tags import tags_key
from costloom.operators import costs as C
from costloom.operators import hierarchy as H
from costloom.plans.catalog import AS_OF, END, EUR_SQL, FITS_SQL, MEMBERS_SQL, RATE, SCOPES_SQL, START, TREE_SQL, query, rounded, scopes, stored_tree

WINDOW_SQL = f"charge_date >= DATE '{START}' AND charge_date < DATE '{END}'"
RECENT_SQL = f"updated_at >= DATE '{AS_OF}' - 7"


def recent():
    """Entities updated in the last seven days."""
    return F.col("updated_at") >= F.lit(AS_OF - dt.timedelta(days=7))


def parents(v):
    """All entities with children."""
    return v.entities.where("parent_id IS NOT NULL").select("parent_id").distinct()


def members(v):
    return H.scope_entities(stored_tree(v), v.entities, scopes(v))


def chargeback(v):
    rules = v.spark.createDataFrame(RULES, "rule_id int, source_tags map<string,string>, target_tags map<string,string>, percentage double")
    return C.Chargeback(v.entities, v.costs, v.kube_metrics, rules, stored_tree(v), START, END, RATE)


#: Allocation rules of the registered queries.
RULES = [(1, {"segment": "BUILDING"}, {"tier": "gold"}, 50.0), (2, {"tier": "bronze"}, {"team": "team1"}, 20.0), (3, {"segment": "BUILDING", "tier": "silver"}, {"segment": "MACHINERY"}, 10.0), (4, {}, {"tier": "gold"}, 5.0)]


@query("entity_closure", f"WITH RECURSIVE {TREE_SQL} SELECT ancestor, descendant, depth FROM tree")
def entity_closure(v):
    return H.closure(v.entities).select("ancestor", "descendant", "depth")


MOVED_SQL = """moved AS (SELECT id, CASE WHEN type = 'vm' AND id % 7 = 0 THEN 100 + (parent_id - 100 + 1) % 25 WHEN id = 103 THEN 2 ELSE parent_id END AS parent_id FROM entities UNION ALL SELECT 5000000 + id, id FROM entities WHERE type = 'vm' AND id % 50 = 0)"""


@query("closure_update", f"WITH RECURSIVE {MOVED_SQL}, tree AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM moved UNION ALL SELECT ancestor, m.id, depth + 1 FROM tree JOIN moved m ON m.parent_id = descendant) SELECT * FROM tree")
def closure_update(v):
    """The stored closure after machines and a cluster have moved and new nodes have come."""
    e = v.entities
    to = F.when((F.col("type") == "vm") & (F.col("id") % 7 == 0), 100 + (F.col("parent_id") - 100 + 1) % 25).when(F.col("id") == 103, F.lit(2))
    moves = e.select("id", to.cast("long").alias("parent_id")).where("parent_id IS NOT NULL")
    new = e.where("type = 'vm' AND id % 50 = 0").select((F.col("id") + 5_000_000).alias("id"), F.col("id").alias("parent_id"))
    return H.moved_closure(stored_tree(v), moves.union(new)).select("ancestor", "descendant", "depth")


@query("scope_entities", f"WITH RECURSIVE {TREE_SQL}, {MEMBERS_SQL} SELECT * FROM members")
def scope_entities(v):
    return members(v)


CHILD_SQL = "EXISTS (SELECT 1 FROM entities c WHERE c.parent_id = e.id) AS has_children"


@query("entity_roots", f"SELECT id, name, type, provider, {CHILD_SQL} FROM entities e WHERE parent_id = 0")
def entity_roots(v):
    return H.entity_roots(v.entities)


@query("entity_children", f"SELECT parent_id, id, name, type, {CHILD_SQL} FROM entities e WHERE parent_id IS NOT NULL")
def entity_children(v):
    return H.entity_children(v.entities, parents(v))


@query("entity_providers", "SELECT DISTINCT provider FROM entities WHERE provider IS NOT NULL")
def entity_providers(v):
    return v.entities.where("provider IS NOT NULL").select("provider").distinct()


@query("entity_count", "SELECT count(*) AS n FROM entities")
def entity_count(v):
    return v.entities.agg(F.count(F.lit(1)).alias("n"))


KEYS_SQL = "SELECT id, 'segment' AS key FROM entities WHERE segment IS NOT NULL UNION ALL SELECT id, 'tier' FROM entities WHERE tier IS NOT NULL UNION ALL SELECT id, 'cluster' FROM entities WHERE cluster IS NOT NULL UNION ALL SELECT id, 'team' FROM entities WHERE team IS NOT NULL"


@query("tag_key_top", f"SELECT key, count(*) AS n FROM ({KEYS_SQL}) GROUP BY key ORDER BY n DESC, key LIMIT 15")
def tag_key_top(v):
    return H.tag_key_top(v.entities)


@query("entity_chain", f"WITH RECURSIVE {TREE_SQL}, up AS (SELECT descendant AS node, ancestor AS id, depth FROM tree WHERE ancestor <> 0 AND descendant > 0) SELECT node, CAST(max(depth) OVER (PARTITION BY node) - depth AS INT) AS position, up.id, name, type FROM up JOIN entities e ON e.id = up.id")
def entity_chain(v):
    nodes = v.entities.where("id > 0").select(F.col("id").alias("node"))
    return H.entity_chain(stored_tree(v), v.entities, nodes)


RECENT_TREE_SQL = f"tree AS (SELECT id AS ancestor, id AS descendant, [id] AS path FROM entities UNION ALL SELECT ancestor, e.id, list_append(path, e.id) FROM tree JOIN entities e ON e.parent_id = descendant AND {RECENT_SQL})"


@query("scoped_tag_key_top", f"""
    WITH RECURSIVE {RECENT_TREE_SQL}, k AS ({KEYS_SQL}), total AS (SELECT ancestor, count(*) AS total FROM tree GROUP BY 1)
    SELECT t.ancestor AS scope_id, key, count(*) AS n, any_value(total) AS total FROM tree t JOIN k ON k.id = t.descendant JOIN total USING (ancestor)
    WHERE t.ancestor IN (SELECT parent_id FROM entities) AND key NOT LIKE 'clus%' GROUP BY 1, 2""")
def scoped_tag_key_top(v):
    return H.scoped_tag_key_top(H.closure(v.entities, pruned=recent()), v.entities, scopes(v), ["clus*"])


@query("scoped_children", f"SELECT parent_id, id, name, type, {CHILD_SQL} FROM entities e WHERE parent_id IS NOT NULL AND ({RECENT_SQL} OR id = 0)")
def scoped_children(v):
    return H.scoped_children(v.entities, parents(v), recent())


@query("scoped_tag_values", f"""
    WITH RECURSIVE {RECENT_TREE_SQL} SELECT ancestor AS scope_id, tier AS value, count(*) AS n FROM tree JOIN entities e ON e.id = descendant
    WHERE tier IS NOT NULL AND ancestor IN (SELECT parent_id FROM entities) GROUP BY 1, 2""")
def scoped_tag_values(v):
    return H.scoped_tag_values(H.closure(v.entities, pruned=recent()), v.entities, scopes(v), "tier")


@query("scoped_dynamic_items", f"""
    WITH RECURSIVE {RECENT_TREE_SQL}, hits AS (SELECT s.scope_id, s.tags_key, path FROM {SCOPES_SQL} JOIN tree ON ancestor = scope_id JOIN entities e ON e.id = descendant WHERE {FITS_SQL}),
    ids AS (SELECT DISTINCT scope_id, tags_key, unnest(path) AS id FROM hits), shown AS (SELECT scope_id, tags_key, e.id, name, type, parent_id FROM ids JOIN entities e ON e.id = ids.id WHERE e.id <> scope_id)
    SELECT s.*, EXISTS (SELECT 1 FROM shown c WHERE c.scope_id = s.scope_id AND c.tags_key = s.tags_key AND c.parent_id = s.id) AS has_children,
      s.parent_id = s.scope_id AND s.id IN (SELECT entity_id FROM metrics WHERE ts >= TIMESTAMP '2024-01-24') AS has_metrics FROM shown s""")
def scoped_dynamic_items(v):
    metered = v.metrics.where("ts >= TIMESTAMP '2024-01-24'").select("entity_id")
    return H.scoped_dynamic_items(H.closure(v.entities, pruned=recent()), v.entities, scopes(v), metered)


@query("namespaces_for_tags", f"SELECT s.scope_id, s.tags_key, id AS ns_id, parent_id AS cluster_id, name AS namespace FROM {SCOPES_SQL} JOIN entities ON {FITS_SQL} WHERE type = 'kubernetes_namespace' AND tags_key <> '{{}}'")
def namespaces_for_tags(v):
    return H.namespaces_for_tags(v.entities, scopes(v)).drop("ns_tags")


@query("cluster_list", "SELECT id, name FROM entities WHERE type = 'kubernetes_cluster' ORDER BY name")
def cluster_list(v):
    return v.entities.where("type = 'kubernetes_cluster'").select("id", "name").orderBy("name")


@query("entity_name", "SELECT DISTINCT scope_id, coalesce(e.name, 'unknown') AS name FROM anomalies a LEFT JOIN entities e ON e.id = a.scope_id")
def entity_name(v):
    names = v.entities.select(F.col("id").alias("scope_id"), "name")
    return v.anomalies.select("scope_id").distinct().join(names, "scope_id", "left").select("scope_id", F.coalesce("name", F.lit("unknown")).alias("name"))


SPINE_SQL = f"days AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}' - 1, INTERVAL 1 DAY))::DATE AS date)"
DAILY_SQL = f"daily AS (SELECT s.scope_id, s.tags_key, d.date, coalesce(sum(cost), 0) AS cost FROM {SCOPES_SQL} CROSS JOIN days d LEFT JOIN (SELECT scope_id, tags_key, charge_date, {EUR_SQL} AS cost FROM costs JOIN members USING (entity_id) WHERE {WINDOW_SQL}) x ON x.scope_id = s.scope_id AND x.tags_key = s.tags_key AND x.charge_date = d.date GROUP BY 1, 2, 3)"


@query("daily_costs", f"WITH RECURSIVE {TREE_SQL}, {MEMBERS_SQL}, {SPINE_SQL}, {DAILY_SQL} SELECT scope_id, tags_key, date, round(cost, 4) AS cost FROM daily")
def daily_costs(v):
    return rounded(C.daily_costs(members(v), scopes(v), v.costs, START, END, RATE), "cost")


@query("usd_to_eur", f"SELECT currency, count(*) AS n, round(sum({EUR_SQL}), 2) AS cost FROM costs GROUP BY 1")
def usd_to_eur(v):
    from costloom.functions.normalize import usd_to_eur as convert

    return v.costs.groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(convert(F.col("billed_cost"), F.col("currency"), RATE)), 2).alias("cost"))


@query("month_window", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next FROM orders")
def month_window(v):
    first = F.trunc("o_orderdate", "month")
    return v.orders.select("o_orderkey", first.alias("first"), F.add_months(first, 1).alias("next"))


CATEGORY_SQL = f"cats AS (SELECT scope_id, tags_key, charge_date AS date, coalesce(category, 'Other') AS category, sum({EUR_SQL}) AS cost FROM costs JOIN members USING (entity_id) WHERE {WINDOW_SQL} GROUP BY 1, 2, 3, 4)"


@query("daily_costs_by_category", f"WITH RECURSIVE {TREE_SQL}, {MEMBERS_SQL}, {CATEGORY_SQL} SELECT scope_id, tags_key, date, category, round(cost, 4) AS cost FROM cats")
def daily_costs_by_category(v):
    return rounded(C.daily_costs_by_category(members(v), v.costs, START, END, RATE), "cost")


@query("daily_costs_by_tag", f"WITH RECURSIVE {TREE_SQL}, {MEMBERS_SQL} SELECT scope_id, tags_key, charge_date AS date, coalesce(e.segment, 'Unrecognized') AS tag_value, round(sum({EUR_SQL}), 4) AS cost FROM costs JOIN members USING (entity_id) JOIN entities e ON e.id = entity_id WHERE {WINDOW_SQL} GROUP BY 1, 2, 3, 4")
def daily_costs_by_tag(v):
    return rounded(C.daily_costs_by_tag(members(v), v.entities, v.costs, "segment", START, END, RATE), "cost")


@query("max_cost_date", f"SELECT max(charge_date) AS max_date FROM costs WHERE {WINDOW_SQL}")
def max_cost_date(v):
    return C.max_cost_date(v.costs, START, END)


def share_sql(metric: str, name: str) -> str:
    return f"""{name}_m AS (SELECT e.parent_id AS cluster_id, e.name AS namespace, date, avg(value) AS value FROM kube_metrics k JOIN entities e ON e.id = k.entity_id WHERE metric = '{metric}' AND date >= DATE '{START}' AND date < DATE '{END}' GROUP BY 1, 2, 3),
      {name}_f AS (SELECT n.cluster_id, n.namespace, d.date, coalesce(m.value, 0) AS value FROM (SELECT DISTINCT cluster_id, namespace FROM {name}_m) n CROSS JOIN days d LEFT JOIN {name}_m m ON m.cluster_id = n.cluster_id AND m.namespace = n.namespace AND m.date = d.date),
      {name} AS (SELECT cluster_id, namespace, date, value / nullif(sum(value) OVER (PARTITION BY cluster_id, date), 0) AS share FROM {name}_f)"""


@query("ns_metric_share", f"WITH {SPINE_SQL}, {share_sql('cpu_requests_cores', 'cpu')} SELECT cluster_id, namespace, date, round(share, 6) AS share FROM cpu")
def ns_metric_share(v):
    return rounded(C.ns_metric_share(v.kube_metrics, v.entities, "cpu_requests_cores", START, END), "share", digits=6)


SHARES_SQL = f"{share_sql('cpu_requests_cores', 'cpu')}, {share_sql('memory_requests_bytes', 'mem')}"
#: Costs of each cluster without tags, and namespaces' parts of a cluster cost table.
PLAIN_SQL = f"plain AS (SELECT e.id AS cluster_id, d.date, coalesce(sum(x.cost), 0) AS cost FROM entities e CROSS JOIN days d LEFT JOIN (SELECT t.ancestor, charge_date, {EUR_SQL} AS cost FROM costs JOIN tree t ON t.descendant = entity_id AND depth > 0 WHERE {WINDOW_SQL}) x ON x.ancestor = e.id AND x.charge_date = d.date WHERE e.type = 'kubernetes_cluster' GROUP BY 1, 2)"


def allocation_sql(name: str, table: str) -> str:
    return f"{name} AS (SELECT cluster_id, namespace, date, coalesce(p.cost, 0) * (0.7 * coalesce(cpu.share, 0) + 0.3 * coalesce(mem.share, 0)) AS cost FROM cpu FULL JOIN mem USING (cluster_id, namespace, date) LEFT JOIN {table} p USING (cluster_id, date))"


@query("ns_allocation", f"WITH RECURSIVE {TREE_SQL}, {SPINE_SQL}, {SHARES_SQL}, {PLAIN_SQL}, {allocation_sql('alloc', 'plain')} SELECT cluster_id, namespace, date, round(cost, 4) AS cost FROM alloc")
def ns_allocation(v):
    c = chargeback(v)
    clusters = v.entities.where("type = 'kubernetes_cluster'").select(F.col("id").alias("scope_id"), F.create_map().cast("map<string,string>").alias("tags"))
    return rounded(C.ns_allocation(*c.shares(), c.raw(clusters).withColumnRenamed("scope_id", "cluster_id")), "cost")


@query("ns_allocation_chart", f"WITH RECURSIVE {TREE_SQL}, {SPINE_SQL}, {SHARES_SQL}, {PLAIN_SQL}, {allocation_sql('alloc', 'plain')} SELECT cluster_id, namespace, count(*) AS days, min(date) AS first, round(arg_min(cost, date), 4) AS first_cost, round(sum(cost), 3) AS total FROM alloc GROUP BY 1, 2")
def ns_allocation_chart(v):
    c = chargeback(v)
    clusters = v.entities.where("type = 'kubernetes_cluster'").select(F.col("id").alias("scope_id"), F.create_map().cast("map<string,string>").alias("tags"))
    chart = C.ns_allocation_chart(C.ns_allocation(*c.shares(), c.raw(clusters).withColumnRenamed("scope_id", "cluster_id")))
    total = F.aggregate("costs", F.lit(0.0), lambda a, x: a + x)
    return chart.select("cluster_id", "namespace", F.size("labels").cast("long").alias("days"), F.col("labels")[0].alias("first"), F.round(F.col("costs")[0], 4).alias("first_cost"), F.round(total, 3).alias("total"))


#: Tag sets that entities carry, as a rule table; one rule has no tags.
RULE_TABLE_SQL = """SELECT DISTINCT segment AS r_segment, tier AS r_tier, NULL AS r_team FROM entities WHERE segment IS NOT NULL UNION SELECT segment, NULL, NULL FROM entities WHERE segment IS NOT NULL
    UNION SELECT NULL, NULL, team FROM entities WHERE team IS NOT NULL"""


def rule_table(v):
    e = v.entities.where("segment IS NOT NULL OR team IS NOT NULL")
    sets = F.array(F.map_filter("tags", lambda k, x: k.isin("segment", "tier", "team")), F.map_filter("tags", lambda k, x: k.isin("segment", "team")), F.create_map().cast("map<string,string>"))
    return e.select(F.explode(sets).alias("source_tags")).withColumn("rule_key", tags_key(F.col("source_tags"))).dropDuplicates(["rule_key"])


@query("tags_match", f"""
    SELECT id, concat('{{', concat_ws(',', '"segment":"' || r_segment || '"', '"team":"' || r_team || '"', '"tier":"' || r_tier || '"'), '}}') AS rule_key
    FROM entities JOIN ({RULE_TABLE_SQL}) ON (r_segment IS NULL OR segment = r_segment) AND (r_tier IS NULL OR tier = r_tier) AND (r_team IS NULL OR team = r_team)""")
def tags_match(v):
    return C.matching_rules(v.entities.select("id", "tags"), rule_table(v), "source_tags").select("id", "rule_key")


#: Source costs of the rules and what they move, per scope.
RULE_ROWS_SQL = "(VALUES (1, 'BUILDING', NULL, NULL, 'gold', NULL, 50.0), (2, NULL, 'bronze', NULL, NULL, 'team1', 20.0), (3, 'BUILDING', 'silver', 'MACHINERY', NULL, NULL, 10.0), (4, NULL, NULL, NULL, 'gold', NULL, 5.0)) AS r(rule_id, s_segment, s_tier, t_segment, t_tier, t_team, pct)"
RULES_SQL = f"""rules AS (SELECT * FROM {RULE_ROWS_SQL}),
  source AS (SELECT r.rule_id, charge_date AS date, sum({EUR_SQL}) AS cost FROM rules r JOIN entities e ON (r.s_segment IS NULL OR e.segment = r.s_segment) AND (r.s_tier IS NULL OR e.tier = r.s_tier) JOIN costs ON costs.entity_id = e.id WHERE {WINDOW_SQL} AND rule_id <> 4 GROUP BY 1, 2)"""


def moved_sql(name: str, scope_rows: str) -> str:
    return f"""{name} AS (SELECT s.scope_id, s.tags_key, source.date, source.cost * pct / 100 AS cost FROM {scope_rows} JOIN rules r ON (t_segment IS NULL OR w_segment = t_segment) AND (t_tier IS NULL OR w_tier = t_tier) AND (t_team IS NULL OR w_team = t_team) JOIN source USING (rule_id)
      UNION ALL SELECT s.scope_id, s.tags_key, source.date, -source.cost * pct / 100 FROM {scope_rows} JOIN rules r ON (s_segment IS NULL OR w_segment = s_segment) AND (s_tier IS NULL OR w_tier = s_tier) AND rule_id <> 4 JOIN source USING (rule_id))"""


@query("allocation_rules_apply", f"WITH RECURSIVE {TREE_SQL}, {MEMBERS_SQL}, {SPINE_SQL}, {DAILY_SQL}, {RULES_SQL}, {moved_sql('moved', SCOPES_SQL)} SELECT scope_id, tags_key, date, round(sum(cost), 4) AS cost FROM (SELECT * FROM daily UNION ALL SELECT * FROM moved) GROUP BY 1, 2, 3")
def allocation_rules_apply(v):
    c = chargeback(v)
    return rounded(c.ruled(c.raw(scopes(v)), scopes(v)), "cost")


NS_SQL = f"ns AS (SELECT s.scope_id, s.tags_key, id AS ns_id, parent_id AS cluster_id, name AS namespace, segment, team FROM {SCOPES_SQL} JOIN entities ON {FITS_SQL} WHERE type = 'kubernetes_namespace' AND tags_key <> '{{}}')"
ALL_SQL = f"{TREE_SQL}, {MEMBERS_SQL}, {SPINE_SQL}, {DAILY_SQL}, {SHARES_SQL}, {PLAIN_SQL}, {allocation_sql('alloc', 'plain')}, {NS_SQL}, {RULES_SQL}, {moved_sql('moved', SCOPES_SQL)}"
#: Clusters under their own cluster tag: own billing costs of tagged entities are none, so namespaces' parts are all.
CLUSTERS_SQL = f"{ALL_SQL}, ccost AS (SELECT cluster_id, date, sum(cost) AS cost FROM alloc GROUP BY 1, 2), {allocation_sql('calloc', 'ccost')}"


@query("agg_costs_k8s", f"WITH RECURSIVE {ALL_SQL} SELECT scope_id, tags_key, date, round(sum(cost), 4) AS cost FROM (SELECT * FROM daily UNION ALL SELECT scope_id, tags_key, date, cost FROM ns JOIN alloc USING (cluster_id, namespace) UNION ALL SELECT * FROM moved) GROUP BY 1, 2, 3")
def agg_costs_k8s(v):
    return rounded(chargeback(v).with_k8s(scopes(v)), "cost")


@query("agg_costs", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT scope_id, tags_key, date, round(sum(cost), 4) AS cost FROM (SELECT * FROM daily UNION ALL SELECT scope_id, tags_key, date, cost FROM ns JOIN calloc USING (cluster_id, namespace) UNION ALL SELECT * FROM moved) GROUP BY 1, 2, 3")
def agg_costs(v):
    return rounded(chargeback(v).aggregated(scopes(v)), "cost")


@query("agg_costs_by_category", f"WITH RECURSIVE {CLUSTERS_SQL}, {CATEGORY_SQL} SELECT scope_id, tags_key, date, category, round(cost, 4) AS cost FROM cats UNION ALL SELECT scope_id, tags_key, date, concat('k8s:', namespace), round(arg_max(cost, ns_id), 4) FROM ns JOIN calloc USING (cluster_id, namespace) GROUP BY 1, 2, 3, 4")
def agg_costs_by_category(v):
    return rounded(chargeback(v).by_category(scopes(v)), "cost")


@query("agg_costs_by_tag", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT scope_id, tags_key, date, tag_value, round(sum(cost), 4) AS cost FROM (SELECT scope_id, tags_key, charge_date AS date, coalesce(e.team, 'Unrecognized') AS tag_value, {EUR_SQL} AS cost FROM costs JOIN members USING (entity_id) JOIN entities e ON e.id = entity_id WHERE {WINDOW_SQL} UNION ALL SELECT scope_id, tags_key, date, coalesce(team, 'Unrecognized'), cost FROM ns JOIN calloc USING (cluster_id, namespace)) GROUP BY 1, 2, 3, 4")
def agg_costs_by_tag(v):
    return rounded(chargeback(v).by_tag(scopes(v), "team"), "cost")


@query("ns_shared_allocations", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT scope_id, tags_key, ns_id, namespace, date, round(cost, 4) AS cost FROM ns JOIN calloc USING (cluster_id, namespace)")
def ns_shared_allocations(v):
    c = chargeback(v)
    return rounded(c.namespace_costs(scopes(v), c.cluster_costs()).select("scope_id", "tags_key", "ns_id", "namespace", "date", "cost"), "cost")


@query("cluster_cost_detail", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT cluster_id, namespace, date, round(cost, 4) AS cost FROM calloc")
def cluster_cost_detail(v):
    c = chargeback(v)
    return rounded(C.ns_allocation(*c.shares(), c.cluster_costs()), "cost")


@query("topn_other", f"""
    WITH RECURSIVE {TREE_SQL}, {MEMBERS_SQL}, {CATEGORY_SQL}, totals AS (SELECT scope_id, tags_key, category, row_number() OVER (PARTITION BY scope_id, tags_key ORDER BY sum(cost) DESC, category) AS k FROM cats GROUP BY 1, 2, 3)
    SELECT scope_id, tags_key, date, CASE WHEN k <= 3 THEN category ELSE 'other' END AS category, round(sum(cost), 4) AS cost FROM cats JOIN totals USING (scope_id, tags_key, category) GROUP BY 1, 2, 3, 4""")
def topn_other(v):
    return rounded(C.topn_other(C.daily_costs_by_category(members(v), v.costs, START, END, RATE), C.SCOPE, n=3), "cost")


CUTOFF = dt.date(1996, 7, 20)
REPORT_SQL = f"""
    pred AS (SELECT scope_id, tags_key, avg(cost) AS predicted FROM daily WHERE date > DATE '{CUTOFF}' - 7 AND date <= DATE '{CUTOFF}' GROUP BY 1, 2),
    vals AS (SELECT d.*, CASE WHEN date <= DATE '{CUTOFF}' THEN cost ELSE greatest(predicted, 0) END AS v FROM daily d JOIN pred USING (scope_id, tags_key)),
    sums AS (SELECT *, sum(v) OVER (PARTITION BY scope_id, tags_key ORDER BY date) AS total FROM vals)"""


@query("month_report", f"""
    WITH RECURSIVE {TREE_SQL}, {MEMBERS_SQL}, {SPINE_SQL}, {DAILY_SQL}, {REPORT_SQL},
    a AS (SELECT scope_id, anomaly_date AS date, arg_min(threshold, CASE WHEN anomaly_type = 'cost' THEN 0 ELSE 1 END) AS threshold FROM anomalies WHERE anomaly_date <= DATE '{CUTOFF}' GROUP BY 1, 2),
    b AS (SELECT scope_id, arg_max(limit_amount, month) AS budget FROM budgets WHERE month <= DATE '{START}' GROUP BY 1)
    SELECT scope_id, tags_key, date, CASE WHEN date <= DATE '{CUTOFF}' THEN round(cost, 4) END AS actual_daily, CASE WHEN date <= DATE '{CUTOFF}' THEN round(total, 4) END AS actual_cumulative,
      CASE WHEN date >= DATE '{CUTOFF}' THEN round(total, 4) END AS forecast_cumulative, coalesce(cost > threshold AND cost > 4, false) AS is_anomaly, round(coalesce(greatest(0, cost - threshold), 0), 4) AS anomaly_delta,
      round(max(total) OVER (PARTITION BY scope_id, tags_key), 4) AS projected_total, round(budget, 4) AS budget FROM sums LEFT JOIN a USING (scope_id, date) LEFT JOIN b USING (scope_id)""")
def month_report(v):
    from costloom.operators import budgets as B

    daily = C.daily_costs(members(v), scopes(v), v.costs, START, END, RATE)
    ahead = B.forecast_sma(daily.where(F.col("date") <= F.lit(CUTOFF)), C.SCOPE, (END - CUTOFF).days - 1)
    found = B.anomalies_for_month(v.anomalies, ["scope_id"], START, END).withColumnRenamed("anomaly_date", "date")
    limits = B.budget_asof(v.budgets, v.budgets.select("scope_id").distinct().withColumn("month", F.lit(START)), ["scope_id"])
    return rounded(C.month_report(daily, ahead, C.SCOPE, CUTOFF, found, limits), "actual_daily", "actual_cumulative", "forecast_cumulative", "anomaly_delta", "projected_total", "budget")


@query("month_breakdown", f"""
    WITH RECURSIVE {TREE_SQL}, {MEMBERS_SQL}, {SPINE_SQL}, {CATEGORY_SQL}, past AS (SELECT * FROM cats WHERE date <= DATE '{CUTOFF}'),
    totals AS (SELECT scope_id, tags_key, category, row_number() OVER (PARTITION BY scope_id, tags_key ORDER BY sum(cost) DESC, category) AS k FROM past GROUP BY 1, 2, 3),
    named AS (SELECT scope_id, tags_key, date, CASE WHEN k <= 5 THEN category ELSE 'other' END AS category, cost FROM past JOIN totals USING (scope_id, tags_key, category))
    SELECT k.scope_id, k.tags_key, k.category, d.date, CASE WHEN d.date <= DATE '{CUTOFF}' THEN round(coalesce(sum(cost), 0), 4) END AS cost
    FROM (SELECT DISTINCT scope_id, tags_key, category FROM named) k CROSS JOIN days d LEFT JOIN named n ON n.scope_id = k.scope_id AND n.tags_key = k.tags_key AND n.category = k.category AND n.date = d.date GROUP BY 1, 2, 3, 4""")
def month_breakdown(v):
    return rounded(C.month_breakdown(C.daily_costs_by_category(members(v), v.costs, START, END, RATE), C.SCOPE, START, END, CUTOFF), "cost")


@query("allocation_rule_check", "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN concat('{\"segment\":\"', c_mktsegment, '\"}') ELSE '{}' END AS source_key, round(sum(c_custkey % 7 / 100.0), 4) AS total, sum(c_custkey % 7 / 100.0) <= 100.001 AS valid FROM customer GROUP BY 1")
def allocation_rule_check(v):
    tags = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.create_map(F.lit("segment"), F.col("c_mktsegment"))).otherwise(F.create_map().cast("map<string,string>"))
    return rounded(C.rule_budget(v.customer.select(tags.alias("source_tags"), (F.col("c_custkey") % 7 / 100.0).alias("percentage"))), "total")


@query("allocation_rule_add", "WITH h AS (SELECT c_mktsegment, sum(c_custkey % 40 + 0.0) AS have FROM customer WHERE c_custkey % 97 = 3 GROUP BY 1), r AS (SELECT c_custkey AS rule_id, c_mktsegment, sum(c_custkey % 40 + 0.0) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS total FROM customer WHERE c_custkey % 97 <> 3) SELECT rule_id, coalesce(have, 0) + total <= 100.001 AS accepted FROM r LEFT JOIN h USING (c_mktsegment)")
def allocation_rule_add(v):
    rows = v.customer.select(F.col("c_custkey").alias("rule_id"), F.create_map(F.lit("segment"), "c_mktsegment").alias("source_tags"), (F.col("c_custkey") % 40 + 0.0).alias("percentage"))
    return C.accept_rules(rows.where("rule_id % 97 = 3"), rows.where("rule_id % 97 <> 3")).select("rule_id", "accepted")


@query("allocation_rule_edit", """
    WITH rules AS (SELECT c_custkey AS rule_id, c_mktsegment, c_custkey % 40 + 0.0 AS percentage FROM customer), have AS (SELECT * FROM rules WHERE rule_id % 97 = 3 AND rule_id NOT IN (SELECT o_custkey FROM orders)),
    h AS (SELECT c_mktsegment, sum(percentage) AS total FROM have GROUP BY 1), r AS (SELECT *, sum(percentage) OVER (PARTITION BY c_mktsegment ORDER BY rule_id) AS running FROM rules WHERE rule_id % 97 <> 3)
    SELECT rule_id, percentage FROM have UNION ALL SELECT rule_id, percentage FROM r LEFT JOIN h USING (c_mktsegment) WHERE coalesce(h.total, 0) + running <= 100.001""")
def allocation_rule_edit(v):
    """Rules of customers with orders are deleted; then all other rules are offered."""
    rows = v.customer.select(F.col("c_custkey").alias("rule_id"), F.create_map(F.lit("segment"), "c_mktsegment").alias("source_tags"), (F.col("c_custkey") % 40 + 0.0).alias("percentage"))
    have = C.delete_rules(rows.where("rule_id % 97 = 3"), v.orders.select(F.col("o_custkey").alias("rule_id")))
    return C.add_rules(have, rows.where("rule_id % 97 <> 3")).select("rule_id", "percentage")
