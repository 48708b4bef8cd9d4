"""Diagnostic bundles: one session's events and rule results in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import BUILTIN, DEMO, Engine
from ..sources.jsonl import envelope


def diagnostic_bundle(events: DataFrame, session_id: str, engine: Engine = Engine((*BUILTIN, DEMO))) -> DataFrame:
    """(session_id, n_events, events as JSON lines in source order, results, violations). Without the session: LookupError."""
    mine = events.filter(F.col("session_id") == session_id)
    if mine.isEmpty():
        raise LookupError(f"no such session: {session_id}")
    lines = mine.groupBy("session_id").agg(F.count("*").alias("n_events"), F.transform(F.array_sort(F.collect_list(F.struct("_ord", envelope(events).alias("line")))), lambda x: x["line"]).alias("events"))
    results = engine.results(mine).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rule", "passed", "n_violations", "max_severity"))).alias("results"))
    found = engine.violations(mine).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rule", "severity", "message", "evidence"))).alias("violations"))
    none = F.array().cast("array<struct<rule:string,severity:string,message:string,evidence:array<bigint>>>")
    return lines.join(results, "session_id").join(found, "session_id", "left").withColumn("violations", F.coalesce("violations", none))
