"""Queries over database instances and their groups, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import services as sv
from tidewright.plans.tables import Query, table


def _environment(segment):
    return (
        F.when(segment == "BUILDING", "prod").when(segment == "MACHINERY", "uat")
        .when(segment == "FURNITURE", "fat").when(segment == "HOUSEHOLD", "dev").otherwise("test")
    )


def _instances(spark, sf_dir):
    """Customers as database instances."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.lower("c_mktsegment").alias("project_name"),
        _environment(F.col("c_mktsegment")).alias("environment"), F.lit("mysql").alias("db_type"),
        F.when(nation == 7, F.concat("c_name", F.lit("-下线"))).otherwise(F.col("c_name")).alias("instance_name"),
        F.when(nation == 3, "  ").when(nation != 4, F.concat(F.lit("10.1.0."), nation.cast("string"))).alias("host"),
        (F.lit(3306) + nation).alias("port"),
        F.when(nation == 5, " ").when(nation != 6, F.concat(F.lit("db"), (key % 50).cast("string"), F.lit(".local:3306")))
        .alias("real_address"),
    )


def service_descriptors(spark, sf_dir):
    """An instance belongs to the groups (nations) its orders are spread over."""
    members = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("instance_id"),
        (F.col("o_orderkey") % 25).cast("int").alias("resourcegroup_id"),
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    groups = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("group_id"), F.concat_ws(" ", "r_name", "n_name").alias("group_name")
    )
    described = sv.service_descriptors(_instances(spark, sf_dir), members, groups)
    return described.select(
        "id", "instance_name", "host_port", "tier", "group_name", "description",
        F.array_join("tags", ",").alias("tags"),
    )


def service_url_map(spark, sf_dir):
    return sv.url_services(_instances(spark, sf_dir), excluded=["Customer#000000009"])


QUERIES: dict[str, Query] = {f.__name__: f for f in (service_descriptors, service_url_map)}

_INSTANCES = """
i AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'prod' WHEN 'MACHINERY' THEN 'uat'
      WHEN 'FURNITURE' THEN 'fat' WHEN 'HOUSEHOLD' THEN 'dev' ELSE 'test' END AS environment,
    CASE WHEN c_nationkey = 7 THEN c_name || '-下线' ELSE c_name END AS instance_name,
    CASE WHEN c_nationkey = 3 THEN '  ' WHEN c_nationkey <> 4 THEN '10.1.0.' || CAST(c_nationkey AS VARCHAR) END AS host,
    3306 + c_nationkey AS port,
    CASE WHEN c_nationkey = 5 THEN ' ' WHEN c_nationkey <> 6 THEN 'db' || CAST(c_custkey % 50 AS VARCHAR) || '.local:3306' END
      AS real_address
  FROM customer)"""

ORACLES: dict[str, str] = {
    "service_descriptors": f"""WITH {_INSTANCES},
      m AS (SELECT DISTINCT o_custkey, o_orderkey % 25 AS g FROM orders),
      n AS (SELECT o_custkey, r_name || ' ' || n_name AS name FROM m JOIN nation ON n_nationkey = g
        JOIN region ON r_regionkey = n_regionkey),
      a AS (SELECT o_custkey, string_agg(name, '::' ORDER BY name) AS group_name,
          string_agg('ResourceGroup.' || name, ',' ORDER BY name) AS tags FROM n GROUP BY o_custkey)
      SELECT id, instance_name, concat_ws(':', host, CAST(port AS VARCHAR)) AS host_port,
        CASE environment WHEN 'prod' THEN 'Tier1' WHEN 'uat' THEN 'Tier2' WHEN 'fat' THEN 'Tier3'
          WHEN 'dev' THEN 'Tier4' ELSE 'Tier5' END AS tier,
        group_name, 'instance_id=' || CAST(id AS VARCHAR) AS description, coalesce(tags, '') AS tags
      FROM i LEFT JOIN a ON o_custkey = id""",
    "service_url_map": f"""WITH {_INSTANCES},
      u AS (SELECT * FROM i WHERE instance_name NOT LIKE '%下线%' AND environment IN ('uat', 'prod')
        AND instance_name NOT IN ('Customer#000000009'))
      SELECT host || ':' || CAST(port AS VARCHAR) AS url_pattern, instance_name AS service_name FROM u
      WHERE host IS NOT NULL AND replace(host, ' ', '') <> ''
      UNION SELECT real_address, instance_name FROM u
      WHERE real_address IS NOT NULL AND replace(real_address, ' ', '') <> ''""",
}
