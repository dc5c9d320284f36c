"""Cost-analytics views over the given star-schema tables.

Each view is one SELECT that both Spark and DuckDB understand; ``{name}`` stands for a table or for
another view. The registry uses the same text as the head of an oracle statement. Money is divided
by primes, so that sums don't fall on the half of a rounded digit.
"""

from __future__ import annotations

import functools
import re
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that time-dependent queries are asked for, of costs and of metrics.
AS_OF, METRICS_AS_OF = "1996-07-31", "2024-01-31"

VIEWS: dict[str, str] = {
    "entities": f"""
        SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'root' AS name, 'root' AS type, CAST(NULL AS STRING) AS provider, CAST(NULL AS STRING) AS region,
          CAST(NULL AS STRING) AS segment, CAST(NULL AS STRING) AS tier, CAST(NULL AS STRING) AS cluster, CAST(NULL AS STRING) AS team, DATE '{AS_OF}' AS updated_at
        UNION ALL
        SELECT CAST(1 + r_regionkey AS BIGINT), CAST(0 AS BIGINT), r_name, 'account', CASE WHEN r_regionkey % 2 = 0 THEN 'aws' ELSE 'azure' END, r_name, NULL, NULL, NULL, NULL, DATE '{AS_OF}' - CAST((1 + r_regionkey) % 10 AS INT) FROM {{region}}
        UNION ALL
        SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), n_name, 'kubernetes_cluster', CASE WHEN n_regionkey % 2 = 0 THEN 'aws' ELSE 'azure' END, r_name, NULL, NULL, NULL, NULL, DATE '{AS_OF}' - CAST((100 + n_nationkey) % 10 AS INT)
        FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT CAST(1000000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), c_name, 'vm', CASE WHEN n_regionkey % 2 = 0 THEN 'aws' ELSE 'azure' END, r_name, c_mktsegment,
          CASE WHEN c_acctbal >= 5000 THEN 'gold' WHEN c_acctbal >= 0 THEN 'silver' ELSE 'bronze' END, NULL, NULL, DATE '{AS_OF}' - CAST(c_custkey % 10 AS INT)
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT CAST(2000000 + s_suppkey AS BIGINT), CAST(100 + s_nationkey AS BIGINT), s_name, 'kubernetes_namespace', CASE WHEN n_regionkey % 2 = 0 THEN 'aws' ELSE 'azure' END, r_name, NULL, NULL, n_name,
          concat('team', CAST(s_suppkey % 5 AS STRING)), DATE '{AS_OF}' - CAST(s_suppkey % 10 AS INT)
        FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "costs": """
        SELECT CAST(1000000 + o_custkey AS BIGINT) AS entity_id, CAST(l_shipdate AS DATE) AS charge_date, l_extendedprice * (1 - l_discount) / 997 AS billed_cost,
          CASE WHEN l_linestatus = 'F' THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN l_linenumber = 7 THEN NULL ELSE o_orderpriority END AS category, l_returnflag AS service, l_partkey AS sku
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "metrics": """
        SELECT CAST(1000000 + user_id AS BIGINT) AS entity_id, event_type AS metric, CAST(ts AS TIMESTAMP) AS ts, value, 5 AS interval_minutes FROM {events}""",
    "kube_metrics": """
        SELECT CAST(2000000 + l_suppkey AS BIGINT) AS entity_id, CAST(l_shipdate AS DATE) AS date, 'cpu_requests_cores' AS metric, l_quantity AS value FROM {lineitem}
        UNION ALL
        SELECT CAST(2000000 + l_suppkey AS BIGINT), CAST(l_shipdate AS DATE), 'memory_requests_bytes', l_extendedprice FROM {lineitem}""",
    "hardware": """
        SELECT CASE WHEN p_partkey % 2 = 0 THEN 'aws' ELSE 'azure' END AS cloud, concat('t', CAST(p_partkey AS STRING)) AS instance_type, lower(p_type) AS family, p_size AS vcpu, p_size * 4.0E0 AS memory_gb,
          CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size * 100.0E0 END AS baseline_iops, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 50.0E0 END AS throughput,
          CASE WHEN p_partkey % 4 = 0 THEN 'arm64' ELSE 'x86_64' END AS architecture, p_partkey % 11 = 0 AS is_gpu, p_partkey % 13 = 0 AS is_confidential, p_partkey % 3 = 0 AS has_local_storage, p_partkey % 5 <> 0 AS supports_premium
        FROM {part}""",
    "pricing": """
        SELECT CASE WHEN p_partkey % 2 = 0 THEN 'aws' ELSE 'azure' END AS cloud, concat('t', CAST(p_partkey AS STRING)) AS instance_type, r_name AS region, os,
          p_size * (p_retailprice / 9973) * (1 + 0.05E0 * r_regionkey) * (CASE WHEN os = 'windows' THEN 1.4E0 ELSE 1.0E0 END) AS hourly_price
        FROM {part} CROSS JOIN {region} CROSS JOIN (SELECT 'linux' AS os UNION ALL SELECT 'windows' AS os) o""",
    "vms": """
        SELECT CAST(1000000 + c_custkey AS BIGINT) AS id, c_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'aws' ELSE 'azure' END AS provider, r_name AS region,
          CASE WHEN c_custkey % 3 = 0 THEN 'windows' ELSE 'linux' END AS os, CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE concat('t', CAST(c_custkey % 200 AS STRING)) END AS instance_type
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "focus_raw": """
        SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Amazon Web Services' WHEN o_orderkey % 7 = 0 THEN 'Other' ELSE 'Microsoft Azure' END AS ProviderName, concat('bill', CAST(o_custkey % 10 AS STRING)) AS BillingAccountId,
          concat('Billing ', CAST(o_custkey % 10 AS STRING)) AS BillingAccountName, CASE WHEN o_orderkey % 2 = 1 THEN concat('/subscriptions/', CAST(o_custkey % 100 AS STRING)) ELSE CAST(o_custkey % 100 AS STRING) END AS SubAccountId,
          concat('Account ', CAST(o_custkey % 100 AS STRING)) AS SubAccountName, 'r1' AS RegionId, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('res', CAST(o_custkey AS STRING)) END AS ResourceId,
          concat('Resource ', CAST(o_custkey AS STRING)) AS ResourceName, 'vm' AS ResourceType, o_orderpriority AS ServiceCategory, 'compute' AS ServiceName, CAST(o_orderkey % 3 AS STRING) AS SkuPriceId,
          CASE WHEN o_orderstatus = 'P' THEN 'Credit' WHEN o_orderkey % 89 = 0 THEN NULL ELSE 'Usage' END AS ChargeCategory, CASE WHEN o_orderkey % 97 = 0 THEN 0.0E0 ELSE o_totalprice / 997 END AS EffectiveCost, 'USD' AS BillingCurrency,
          CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 + o_orderkey % 30 ELSE 1 END AS INT) AS end_date
        FROM {orders}""",
    "budgets": """
        SELECT CAST(100 + c_nationkey AS BIGINT) AS scope_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_extendedprice * (1 - l_discount) / 997) * 1.1E0 AS limit_amount
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        WHERE month(l_shipdate) % 3 = 1 GROUP BY 1, 2""",
    "forecast_history": """
        SELECT CAST(100 + c_nationkey AS BIGINT) AS scope_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS target_month, CAST(o_orderdate AS DATE) AS forecast_date, sum(o_totalprice) / 997 AS projected_amount
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "anomalies": """
        SELECT CAST(100 + c_nationkey AS BIGINT) AS scope_id, CAST(o_orderdate AS DATE) AS anomaly_date, CASE WHEN o_orderstatus = 'F' THEN 'cost' ELSE 'budget' END AS anomaly_type,
          max(o_totalprice) / 997 AS actual_cost, avg(o_totalprice) / 997 AS threshold, count(*) % 2 = 0 AS is_seen
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1, 2, 3""",
    "recommendations": """
        SELECT CAST(2000000 + l_suppkey AS BIGINT) AS entity_id, CASE WHEN l_linenumber % 2 = 0 THEN 'Deployment' ELSE 'StatefulSet' END AS workload_type, concat('w', CAST(l_partkey % 50 AS STRING)) AS workload, concat('c', CAST(l_linenumber AS STRING)) AS container,
          CAST(l_shipdate AS DATE) AS scanned, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'None' WHEN l_linenumber = 5 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) / 8 AS STRING) END AS cpu,
          CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) * CASE WHEN l_linenumber < 3 THEN 1 ELSE 100000 END AS STRING) END AS memory
        FROM {lineitem}""",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def names_in(sql: str) -> list[str]:
    """The ``{name}`` parts of a view's text."""
    return list(dict.fromkeys(n for _, n, _, _ in Formatter().parse(sql) if n))


class Standins:
    """Lazy DataFrames of the views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                df = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in names_in(VIEWS[name])})
                if name == "entities":
                    pairs = [x for c in ("segment", "tier", "cluster", "team") for x in (F.lit(c), F.col(c))]
                    df = df.withColumn("tags", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))
            elif name in TABLES:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
            self._made[name] = df
        return self._made[name]


@functools.cache
def _head(names: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in names_in(VIEWS[name]):
                visit(n)
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({VIEWS[name].format(**{n: n for n in names_in(VIEWS[name])})})" for name in order]
    return ", ".join(parts)


def with_views(body: str) -> str:
    """A DuckDB statement whose head defines the views that the body names."""
    used = tuple(v for v in VIEWS if re.search(rf"\b{v}\b", body))
    head = _head(used)
    text = body.strip()
    if not head:
        return text
    if re.match(r"WITH RECURSIVE\b", text):
        return f"WITH RECURSIVE {head}, {text[len('WITH RECURSIVE'):]}"
    if re.match(r"WITH\b", text):
        return f"WITH {head}, {text[len('WITH'):]}"
    return f"WITH {head} {text}"
