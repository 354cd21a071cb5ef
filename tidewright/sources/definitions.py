"""Exported ETL definitions: scheduler tasks, data sources and stream jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.once import settled

TASK_SCHEMA = (
    "projectName string, processDefinitionName string, taskName string, taskCode bigint, "
    "userName string, taskType string, taskParams struct<sql:string,json:string,datasource:int>"
)


def task_rows(documents: DataFrame, text_col: str = "value") -> DataFrame:
    """Task definitions from JSON documents."""
    parsed = settled(documents, {"t": F.from_json(text_col, TASK_SCHEMA)})
    return parsed.filter(F.col("t.taskCode").isNotNull()).select(
        F.col("t.taskCode").alias("task_code"),
        F.col("t.taskType").alias("task_type"),
        F.col("t.taskParams.sql").alias("sql"),
        F.col("t.taskParams.json").alias("json"),
        F.col("t.taskParams.datasource").alias("datasource"),
        provenance("t.taskType", "t.projectName", "t.processDefinitionName", "t.taskName", "t.userName")
        .alias("description"),
    )


def provenance(kind: str, project: str, workflow: str, task: str, owner: str):
    """Where an edge comes from, one fact per line."""
    facts = (("kind", kind), ("project", project), ("workflow", workflow), ("task", task), ("owner", owner))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(col)) for label, col in facts])


def datasource_urls(sources: DataFrame) -> DataFrame:
    """Data source id to JDBC URL, from the JSON text in ``connectionParams``."""
    url = F.get_json_object("connectionParams", "$.jdbcUrl")
    return sources.select(F.col("id").alias("datasource"), url.alias("jdbc_url")).filter(
        F.coalesce("jdbc_url", F.lit("")) != ""
    )


def stream_scripts(jobs: DataFrame) -> DataFrame:
    """SQL text of stream jobs (kind 1), which arrives base64-encoded."""
    return jobs.filter(F.col("app_type") == 1).select(
        "app_id", F.decode(F.unbase64("flink_sql"), "UTF-8").alias("script")
    )
