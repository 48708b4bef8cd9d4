"""Traces seen in a table of user events (event_id, ts, user_id, event_type, value, props).

The view is fixed: k is the number in props; a session is a user's day, or with coarse a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same text runs on Spark and DuckDB, with k, session and integer casts filled in.
VIEW = """
SELECT event_id AS _ord, ts, user_id, session_id, k, kind,
       CASE WHEN kind = 'ScreenOpened' THEN CASE WHEN k % 5 = 4 THEN 'ErrorModal' ELSE concat('S', CAST(k % 5 AS {string})) END END AS screen_id,
       CASE WHEN kind = 'NavigationOccurred' THEN concat('S', CAST(k % 5 AS {string})) END AS nav_from,
       CASE WHEN kind = 'NavigationOccurred' THEN concat('S', CAST((k + 1) % 5 AS {string})) END AS nav_to,
       CASE WHEN kind = 'CommandExecuted' THEN concat(event_type, CASE k % 3 WHEN 0 THEN '.Save' WHEN 1 THEN '.Open' ELSE '.Submit' END) END AS command_id,
       CASE WHEN kind IN ('CommandExecuted', 'AsyncOperationCompleted') THEN CASE WHEN value >= 120 THEN 'failure' WHEN k % 17 = 0 THEN 'cancelled' WHEN k % 19 = 0 THEN 'timed_out' ELSE 'success' END END AS outcome,
       CASE WHEN kind = 'CommandExecuted' THEN props END AS args,
       CASE WHEN kind IN ('CommandExecuted', 'AsyncOperationCompleted') THEN CAST(floor(value) AS BIGINT) END AS duration_ms,
       CASE WHEN kind = 'ExceptionThrown' THEN CASE WHEN k % 5 = 0 THEN 'NegativeEx' ELSE concat('Ex', CAST(k % 3 AS {string})) END END AS exception_type,
       CASE WHEN kind = 'ExceptionThrown' THEN concat('m', CAST(k AS {string})) END AS message,
       CASE WHEN kind = 'ValidationFailed' THEN concat('V', CAST(k % 4 AS {string})) END AS validator,
       CASE WHEN kind IN ('ValidationFailed', 'FieldChanged') THEN concat('F', CAST(k % 6 AS {string})) END AS field_id,
       CASE WHEN kind = 'AsyncOperationCompleted' THEN concat('op', CAST(k % 4 AS {string})) END AS operation_id,
       CASE WHEN k % 2 = 0 THEN concat('Entity:', CAST(k AS {string})) END AS domain_entity_id,
       CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'normal' ELSE 'abnormal' END AS phase, value,
       row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS seq
FROM (
  SELECT *, CASE WHEN event_type = 'view' THEN CASE WHEN k % 10 = 3 THEN 'FieldChanged' ELSE 'ScreenOpened' END
                 WHEN event_type = 'signup' AND k % 3 = 0 THEN 'NavigationOccurred'
                 WHEN event_type = 'click' AND k % 10 = 7 THEN 'AsyncOperationCompleted'
                 WHEN event_type IN ('click', 'purchase', 'signup') THEN 'CommandExecuted'
                 WHEN k % 4 = 0 THEN 'ValidationFailed' ELSE 'ExceptionThrown' END AS kind
  FROM (SELECT event_id, {ts} AS ts, user_id, event_type, value, props, {session} AS session_id, {k} AS k FROM {events}) a
) b
"""


def _session(coarse: bool, string: str) -> str:
    return f"CAST(user_id AS {string})" if coarse else f"concat(CAST(user_id AS {string}), '/', CAST(CAST(ts AS DATE) AS {string}))"


def duckdb_view(coarse: bool = False, extra: str = "") -> str:
    return VIEW.format(string="VARCHAR", ts="ts", session=_session(coarse, "VARCHAR"), k="CAST(json_extract(props, '$.k') AS INTEGER)", events="events") + extra


def trace_view(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sql = VIEW.format(string="STRING", ts="CAST(ts AS TIMESTAMP)", session=_session(coarse, "STRING"), k="CAST(get_json_object(props, '$.k') AS INT)", events="{events}")
    return spark.sql(sql, events=events).withColumn("seq", F.col("seq").cast("bigint"))
