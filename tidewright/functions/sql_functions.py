"""The jobs' functions under SQL names, for use in queries and LATERAL joins.

They are SQL functions, so the optimizer inlines them; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewright.functions.text import LONGEST_CLOCK

SPLIT = """
CREATE OR REPLACE TEMPORARY FUNCTION f_str_split(p_str STRING, p_delimiter STRING)
RETURNS TABLE (piece_no INT, piece STRING)
RETURN SELECT pos + 1, nullif(col, '') FROM LATERAL posexplode(
  CASE WHEN p_delimiter IS NULL THEN cast(array() AS array<string>)
    WHEN p_str IS NULL THEN array(cast(NULL AS STRING))
    ELSE split(p_str, concat('\\\\Q', p_delimiter, '\\\\E'), -1) END)
"""

# The wording of the estimate.
ROLLBACK_TIME = f"""
CREATE OR REPLACE TEMPORARY FUNCTION f_rollback_time(rows_before BIGINT, rows_after BIGINT, seconds BIGINT)
RETURNS STRING
RETURN CASE WHEN rows_before > rows_after THEN (
  SELECT concat('回滚估计时间 : ', format_string('%02d:%02d:%02d', held div 3600, held % 3600 div 60, held % 60),
    ' 待回滚行数 ', rows_after)
  FROM (SELECT least(cast(round(cast(rows_after * seconds AS DECIMAL(28,0)) / (rows_before - rows_after)) AS BIGINT),
    {LONGEST_CLOCK}) AS held)) END
"""


def register(spark: SparkSession) -> None:
    """Create ``f_str_split`` and ``f_rollback_time`` for this session."""
    for definition in (SPLIT, ROLLBACK_TIME):
        spark.sql(definition)
