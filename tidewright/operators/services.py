"""Service descriptors for registering database instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Environment to tier.
TIERS = {"prod": "Tier1", "uat": "Tier2", "fat": "Tier3", "dev": "Tier4"}
OTHER_TIER = "Tier5"


def tier(environment: Column) -> Column:
    chain = F
    for name, label in TIERS.items():
        chain = chain.when(environment == name, label)
    return chain.otherwise(OTHER_TIER)


def group_tags(groups: Column) -> Column:
    """``a:: b ::`` as ``[ResourceGroup.a, ResourceGroup.b]``."""
    named = F.filter(F.transform(F.split(groups, "::"), lambda g: F.trim(g)), lambda g: g != "")
    return F.transform(named, lambda g: F.concat(F.lit("ResourceGroup."), g))


def service_descriptors(instances: DataFrame, memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """Each instance with its address, tier, groups (by name, joined by ``::``) and tags.

    A membership is one (instance, group) pair, so the names of an instance are bounded by
    the number of groups.
    """
    named = (
        memberships.select("instance_id", "resourcegroup_id").distinct()
        .join(groups, F.col("resourcegroup_id") == F.col("group_id"))
        .groupBy("instance_id")
        .agg(F.array_join(F.array_sort(F.collect_list("group_name")), "::").alias("group_name"))
    )
    return instances.join(named, F.col("id") == F.col("instance_id"), "left").select(
        "id", "project_name", "db_type", "instance_name",
        F.concat_ws(":", "host", F.col("port").cast("string")).alias("host_port"),
        tier(F.col("environment")).alias("tier"),
        "group_name",
        F.coalesce(group_tags(F.col("group_name")), F.array().cast("array<string>")).alias("tags"),
        F.concat(F.lit("instance_id="), F.col("id").cast("string")).alias("description"),
    )


def url_services(
    instances: DataFrame, offline_mark: str = "下线", excluded: list[str] | None = None,
    environments=("uat", "prod"),
) -> DataFrame:
    """Distinct (url pattern, service name) pairs from addresses and real addresses."""
    usable = instances.filter(
        ~F.col("instance_name").contains(offline_mark) & F.col("environment").isin(*environments)
    )
    if excluded:
        usable = usable.filter(~F.col("instance_name").isin(excluded))

    def filled(name: str) -> Column:
        return F.col(name).isNotNull() & (F.replace(F.col(name), F.lit(" "), F.lit("")) != "")

    address = F.concat_ws(":", "host", F.col("port").cast("string"))
    by_host = usable.filter(filled("host")).select(
        address.alias("url_pattern"), F.col("instance_name").alias("service_name")
    )
    by_real = usable.filter(filled("real_address")).select(
        F.col("real_address").alias("url_pattern"), F.col("instance_name").alias("service_name")
    )
    return by_host.union(by_real).distinct()
