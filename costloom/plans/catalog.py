"""Registration of queries: a Spark function over the stand-in views, with its DuckDB statement."""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.functions.tables import shared_folder
from costloom.operators.hierarchy import stored_closure
from costloom.sources.standins import Standins, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

START, END = dt.date(1996, 7, 1), dt.date(1996, 8, 1)
AS_OF, METRICS_AS_OF = dt.date(1996, 7, 31), dt.date(2024, 1, 31)
RATE = 0.92
#: The registered queries ask for every entity with children under each of these tag sets.
TAG_SETS: list[dict[str, str]] = [{}, {"segment": "BUILDING"}, {"segment": "MACHINERY", "tier": "gold"}, {"tier": "gold"}, {"team": "team1"}, {"team": "team2"}]
#: The same in DuckDB, tags as the columns they are in the views.
SCOPES_SQL = """(SELECT p.scope_id, t.* FROM (SELECT DISTINCT parent_id AS scope_id FROM entities WHERE parent_id IS NOT NULL) p CROSS JOIN (VALUES ('{}', NULL, NULL, NULL), ('{"segment":"BUILDING"}', 'BUILDING', NULL, NULL), ('{"segment":"MACHINERY","tier":"gold"}', 'MACHINERY', 'gold', NULL), ('{"tier":"gold"}', NULL, 'gold', NULL), ('{"team":"team1"}', NULL, NULL, 'team1'), ('{"team":"team2"}', NULL, NULL, 'team2')) AS t(tags_key, w_segment, w_tier, w_team)) AS s"""
FITS_SQL = "(w_segment IS NULL OR segment = w_segment) AND (w_tier IS NULL OR tier = w_tier) AND (w_team IS NULL OR team = w_team)"
#: The tree of entities below every node, as DuckDB's recursive part.
TREE_SQL = "tree AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM entities UNION ALL SELECT ancestor, e.id, depth + 1 FROM tree JOIN entities e ON e.parent_id = descendant)"
MEMBERS_SQL = f"members AS (SELECT s.scope_id, s.tags_key, e.id AS entity_id FROM {SCOPES_SQL} JOIN tree ON ancestor = scope_id AND depth > 0 JOIN entities e ON e.id = descendant WHERE {FITS_SQL})"
EUR_SQL = f"billed_cost * CASE WHEN currency = 'USD' THEN {RATE} ELSE 1.0 END"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of :class:`Standins` under a name, with its DuckDB statement."""

    def add(f: Callable[[Standins], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Standins(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """The final presentation of money and shares."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def stored_tree(v: Standins) -> DataFrame:
    """The closure of the view's entities, stored once for all queries of the application over the same tables."""
    spark = v.spark
    folder = f"{shared_folder(spark)}/costloom/{spark.sparkContext.applicationId}/closure-{zlib.crc32(v.folder.encode()):08x}"
    return stored_closure(v.entities, folder)


def scopes(v: Standins) -> DataFrame:
    sets = F.array(*[F.create_map(*[F.lit(x) for pair in tags.items() for x in pair]).cast("map<string,string>") for tags in TAG_SETS])
    parents = v.entities.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("scope_id")).distinct()
    return parents.select("scope_id", F.explode(sets).alias("tags"))
