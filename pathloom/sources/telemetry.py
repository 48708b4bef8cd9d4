"""Import of service telemetry (spans, logs, trace selectors, alarms) as events, with provenance and counters.

One session per selected trace id that has a span or log. A session's alarms are those of its pods. Events are ordered by
time, then alarms before spans before logs, then source row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import rfc3339_nanos, service_of, uuid5

SPAN_COLUMNS = "TraceID string, SpanID string, ParentID string, PodName string, OperationName string, StartTimeUnixNano string, EndTimeUnixNano string, Duration string"
LOG_COLUMNS = ["Timestamp", "TimeUnixNano", "Node", "PodName", "Container", "TraceID", "SpanID", "Log"]
#: How kinds are ordered at one time.
KIND_RANK = {"alert": 0, "span": 1, "log": 2}


@dataclass(frozen=True)
class Imported:
    """events, provenance and rejections are tables; counters is (name, value)."""

    events: DataFrame
    provenance: DataFrame
    counters: DataFrame
    rejections: DataFrame


def _numbered(df: DataFrame) -> DataFrame:
    """Adds row: ordered like the source's rows. Numbers have gaps between splits, and none within a file of one split."""
    return df.withColumn("row", F.monotonically_increasing_id())


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark.read.schema(SPAN_COLUMNS).csv(path, header=True, quote='"', escape='"'))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines; the body is what follows the seventh comma, so that commas and quotes in it do no harm."""
    lines = _numbered(spark.read.option("lineSep", "\n").text(path)).filter(~F.col("value").startswith(",".join(LOG_COLUMNS[:3])))
    parts = F.split(F.regexp_replace("value", r"\r\z", ""), ",", 8)
    body = F.regexp_extract(F.get(parts, F.lit(7)), r'(?s)^"?(.*?)"?\z', 1)
    fields = [F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(LOG_COLUMNS[:7])]
    repaired = F.size(F.split(F.regexp_replace(F.get(parts, F.lit(7)), r'^"(?:[^"]|"")*"\z', ""), ",")) > 1
    return lines.select("row", *fields, F.when(F.size(parts) == 8, F.replace(body, F.lit('""'), F.lit('"'))).alias("Log"), repaired.alias("repaired"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, time, pod, metric_type, value) of metric files: one column a metric, one file a pod (its name, before
    _metric.csv). What is no number is no metric."""
    wide = spark.read.csv(path, header=True, quote='"', escape='"')
    names = [c for c in wide.columns if c not in ("Time", "TimeStamp", "PodName")]
    file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    numbered = _numbered(wide.withColumn("file", file).withColumn("pod", F.regexp_replace(file, r"_metric\.csv.*$", "")))
    metrics = F.explode(F.array(*(F.struct(F.lit(c).alias("metric_type"), F.expr(f"try_cast(`{c}` AS DOUBLE)").alias("value")) for c in names)))
    long = numbered.select("file", "row", F.col("Time").alias("time"), "pod", metrics.alias("m"))
    return long.select("file", "row", "time", "pod", "m.metric_type", "m.value").filter("value is not null")


def read_selectors(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark.read.text(path)).select(F.trim("value").alias("trace_id"), "row").filter("trace_id <> ''")


def import_window(spans: DataFrame, logs: DataFrame, selectors: DataFrame, alarms: DataFrame, scope: str, window_start: str, namespace: uuid.UUID, cluster_id: Column | None = None) -> Imported:
    """Events of one window. alarms: (pod, position, metric_type); scope: what names sessions apart, before the trace id.

    cluster_id gives a log's template number from its columns (a column of that name without it).
    """
    wanted = selectors.groupBy("trace_id").agg(F.min("row").alias("session_ord"), F.count("*").alias("listed"))
    start, took = F.expr("try_cast(StartTimeUnixNano AS BIGINT)"), F.expr("try_cast(Duration AS BIGINT)")
    span_rows = spans.withColumnRenamed("TraceID", "trace_id").join(wanted, "trace_id")
    bad_span = F.when(start.isNull() | took.isNull(), "span:not a number").when(F.coalesce(F.col("PodName"), F.lit("")).isin("", "nan") | F.coalesce(F.col("OperationName"), F.lit("")).isin("", "nan"), "span:missing pod/operation")
    span_rows = span_rows.withColumn("reason", bad_span)
    good = span_rows.filter("reason is null")
    from_spans = good.select(
        "trace_id", "session_ord", start.alias("ts_nanos"), F.lit("span").alias("source"), "row", F.col("PodName").alias("pod"),
        F.concat(F.lit("span:"), service_of(F.col("PodName")), F.lit(" "), "OperationName").alias("command_id"),
        F.to_json(F.struct(F.col("ParentID").alias("parent_id"), F.col("PodName").alias("pod"), F.col("SpanID").alias("span_id"))).alias("args"),
        F.call_function("div", F.greatest(took, F.lit(0)), F.lit(1000)).alias("duration_ms"), F.concat(F.lit("span:"), "SpanID").alias("domain_entity_id"),
    )
    at = F.expr("try_cast(TimeUnixNano AS BIGINT)")
    log_rows = logs.withColumnRenamed("TraceID", "trace_id").join(wanted, "trace_id").withColumn("reason", F.when(at.isNull(), "log:not a number").when(F.coalesce(F.col("PodName"), F.lit("nan")).isin("", "nan") | F.col("Log").isNull(), "log:missing pod/log body"))
    kept = log_rows.filter("reason is null")
    from_logs = kept.select(
        "trace_id", "session_ord", at.alias("ts_nanos"), F.lit("log").alias("source"), "row", F.col("PodName").alias("pod"), F.concat(F.lit("log:"), (cluster_id if cluster_id is not None else F.col("cluster_id")).cast("string")).alias("command_id"),
        F.to_json(F.struct(F.col("PodName").alias("pod"))).alias("args"), F.lit(0).cast("bigint").alias("duration_ms"), F.concat(F.lit("span:"), "SpanID").alias("domain_entity_id"),
    )
    found = from_spans.unionByName(from_logs)
    pods = found.select("trace_id", "session_ord", "pod").distinct()
    opened = F.unix_seconds(F.to_timestamp(F.lit(f"{window_start}:00"))) * 1_000_000_000
    # The position of an alarm among a session's pods in order is its row, so that ties sort by pod.
    alerts = pods.join(alarms, "pod").select("trace_id", "session_ord", opened.alias("ts_nanos"), F.lit("alert").alias("source"), F.col("position").cast("bigint").alias("row"), "pod", F.concat(F.lit("alert:"), "metric_type").alias("command_id"), F.to_json(F.struct("pod")).alias("args"), F.lit(0).cast("bigint").alias("duration_ms"), F.concat(F.lit("pod:"), "pod").alias("domain_entity_id"))
    every = found.unionByName(alerts)
    rank = F.create_map(*(F.lit(x) for kv in KIND_RANK.items() for x in kv))[F.col("source")]
    order = Window.partitionBy("trace_id").orderBy("ts_nanos", rank, "row", "pod")
    events = every.withColumn("seq", F.row_number().over(order).cast("bigint") - 1).withColumn("session_id", uuid5(namespace, F.concat(F.lit(f"{scope}/"), "trace_id"))).withColumn("correlation_id", uuid5(namespace, F.col("trace_id")))
    events = events.withColumns({"kind": F.lit("CommandExecuted"), "outcome": F.lit("success"), "ts": F.timestamp_micros(F.call_function("div", F.col("ts_nanos"), F.lit(1000))), "stamp": rfc3339_nanos(F.col("ts_nanos")), "_ord": F.struct("session_ord", "seq")})
    provenance = events.select("session_id", "seq", F.concat("source", F.lit("-v1")).alias("rule"), "source", "row", "pod")
    rejections = span_rows.unionByName(log_rows, allowMissingColumns=True).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    sessions = events.groupBy("session_id").agg(F.bool_or(F.col("source") == "span").alias("spanned"))

    def count(df: DataFrame, name: str, value: Column = F.count("*")) -> DataFrame:
        return df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("name"), F.coalesce("value", F.lit(0)).alias("value"))

    parts = [
        count(selectors, "selectors_listed"), count(wanted, "selectors_unique"), count(wanted, "selectors_repeated", F.sum(F.col("listed") - 1)),
        count(spans, "spans_read"), count(span_rows, "spans_selected"), count(good, "spans_accepted"), count(logs, "logs_read"), count(log_rows, "logs_selected"), count(kept, "logs_accepted"),
        count(logs, "logs_repaired", F.count_if("repaired") if "repaired" in logs.columns else F.lit(0)), count(alerts, "alerts_emitted"), count(events, "events_emitted"),
        count(sessions, "sessions_emitted"), count(sessions, "log_only_sessions", F.count_if(~F.col("spanned"))),
    ]
    counters = parts[0]
    for p in parts[1:]:
        counters = counters.unionByName(p)
    return Imported(events, provenance, counters, rejections)


#: Conservation laws of the counters, for gates.conservation.
LAWS = {
    "every accepted row is an event": ("events_emitted", [(1, "spans_accepted"), (1, "logs_accepted"), (1, "alerts_emitted")]),
    "selectors are unique or repeated": ("selectors_listed", [(1, "selectors_unique"), (1, "selectors_repeated")]),
}
