"""Proofs of alarms: each alarmed pod and metric with the source rows that its value comes from, or no result at all.

CPU and memory alarms rest on metric samples of the window with just that value. Network alarms rest on the latency pairs of
the pod's calls (rca.latency_p90); a pod without a span of its own rests on its service's threshold. An alarm without
a proof, or with one of another value, makes the job fail, so that a table of proofs is complete when it can be read.

A pod can have any number of calls. alarm_inputs has a row for each source row and alarm_counts their numbers; alarm_proofs has
lists, for proofs that fit a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import service_of
from ..sources.scratch import staged
from .rca import Latency, latency, pod_latency

#: Metrics that are samples; the value of pods of the front, which no alarm can rest on; kinds of proof.
SAMPLED = ("CpuUsageRate(%)", "MemoryUsageRate(%)")
FRONT = "front"
SAMPLE, TRACE, FALLBACK = "metric-sample", "trace-derived-p90", "fallback-threshold"
INPUT = "struct<file:string,row:bigint,parent_row:bigint>"


def _or_stop(good: Column, value: Column, kind: str, *text: Column) -> Column:
    """value where good holds; elsewhere the job fails with the text."""
    return F.when(good, value).otherwise(F.raise_error(F.concat(*text)).cast(kind))


def _named(what: str) -> list[Column]:
    return [F.lit(f"{what} "), F.col("pod"), F.lit(" "), F.col("metric_type")]


def _input(file: Column, row: Column, parent_row: Column) -> Column:
    return F.struct(file.alias("file"), row.alias("row"), parent_row.alias("parent_row")).cast(INPUT).alias("input")


def _network_heads(alarms: DataFrame, spans: DataFrame, thresholds: DataFrame, found: Latency) -> DataFrame:
    """Alarms (pod, metric_type, value) of network latency with kind and n_samples; those of another value than derived fail."""
    pods = alarms.select("pod", service_of(F.col("pod")).alias("service")).distinct()
    met = alarms.join(pod_latency(spans, thresholds, pods, found=found), "pod", "left")
    front = ~F.contains("pod", F.lit(FRONT))
    proven = F.coalesce(F.col("p90") == F.col("value"), F.lit(False))
    value = _or_stop(front, _or_stop(proven, F.col("p90"), "double", *_named("another value than derived for"), F.lit(": "), F.coalesce(F.col("p90").cast("string"), F.lit("none"))), "double", *_named("a constant cannot alarm:"))
    return met.select("pod", "metric_type", F.col("source").alias("kind"), value.alias("value"), F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples"))


def _heads(alarms: DataFrame, spans: DataFrame, thresholds: DataFrame, found: Latency) -> DataFrame:
    """(pod, metric_type, kind, value, n_samples) of each alarm once, staged: a small table that its inputs are joined with.

    Samples of metrics are counted with the inputs.
    """
    order = F.struct("position", "value") if "position" in alarms.columns else F.col("value")
    once = alarms.groupBy("pod", "metric_type").agg(F.min_by("value", order).alias("value"))
    once = once.withColumn("value", _or_stop(F.col("value").isNotNull(), F.col("value").cast("double"), "double", *_named("no value for the alarm of")))
    sampled = F.col("metric_type").isin(*SAMPLED)
    samples = once.filter(sampled).select("pod", "metric_type", F.lit(SAMPLE).alias("kind"), "value", F.lit(None).cast("bigint").alias("n_samples"))
    return staged(samples.unionByName(_network_heads(once.filter(~sampled), spans, thresholds, found)), "alarm-heads")


def _inputs(heads: DataFrame, metrics: DataFrame, window: str, calls: DataFrame, file: str) -> DataFrame:
    """(pod, metric_type, input): the metric rows of the window with the alarm's value, the calls of the pod, the threshold."""
    none = F.lit(None).cast("bigint")
    rows = metrics.filter(F.col("time").contains(window)).select("pod", "metric_type", F.col("value").cast("double").alias("value"), _input(F.col("file"), F.col("row"), none))
    of_samples = rows.join(heads.filter(F.col("kind") == SAMPLE), ["pod", "metric_type", "value"])
    pairs = calls.select("pod", _input(F.lit(file), F.col("child_row"), F.col("parent_row")))
    of_calls = pairs.join(heads.filter(F.col("kind") == TRACE), "pod")
    of_services = heads.filter(F.col("kind") == FALLBACK).withColumn("input", _input(service_of(F.col("pod")), F.lit(0), none))
    return reduce(DataFrame.unionByName, (x.select("pod", "metric_type", "input") for x in (of_samples, of_calls, of_services)))


def _closed(heads: DataFrame, inputs: DataFrame, *gathered: Column) -> DataFrame:
    """heads with n_inputs and what else is gathered from the inputs; an alarm of samples that has none fails."""
    counted = inputs.groupBy("pod", "metric_type").agg(F.count("*").alias("n_inputs"), *gathered)
    met = heads.join(counted, ["pod", "metric_type"], "left")
    n = F.coalesce("n_inputs", F.lit(0).cast("bigint"))
    n = _or_stop((F.col("kind") != SAMPLE) | (n > 0), n, "bigint", *_named("no metric row for"))
    return met.withColumn("n_inputs", n).withColumn("n_samples", F.coalesce("n_samples", "n_inputs"))


def alarm_inputs(alarms: DataFrame, metrics: DataFrame, window: str, spans: DataFrame, thresholds: DataFrame, file: str = "") -> DataFrame:
    """(pod, metric_type, file, row, parent_row): one row for each source row of each alarm, as for alarm_proofs, of any number.

    That each alarm of samples has a row is for alarm_counts to say.
    """
    found = latency(spans)
    return _inputs(_heads(alarms, spans, thresholds, found), metrics, window, found.calls, file).select("pod", "metric_type", "input.*")


def alarm_counts(alarms: DataFrame, metrics: DataFrame, window: str, spans: DataFrame, thresholds: DataFrame, found: Latency | None = None) -> DataFrame:
    """(pod, metric_type, kind, value, n_samples, n_inputs): alarm_proofs with the number of source rows in place of the lists.

    found: the latency of the spans where the caller has it.
    """
    found = found or latency(spans)
    heads = _heads(alarms, spans, thresholds, found)
    return _closed(heads, _inputs(heads, metrics, window, found.calls, "")).select("pod", "metric_type", "kind", "value", "n_samples", "n_inputs")


def alarm_proofs(alarms: DataFrame, metrics: DataFrame, window: str, spans: DataFrame, thresholds: DataFrame, file: str = "") -> DataFrame:
    """(pod, metric_type, kind, value, n_samples, inputs): one row for each alarmed pod and metric.

    alarms: (pod, metric_type, value); of several values for one pod and metric the first counts where there is a column
    position, else the least. A null value fails. metrics: (file, row, time, pod, metric_type, value); spans as for
    rca.latency_pairs; thresholds: (service, value).
    """
    found = latency(spans)
    heads = _heads(alarms, spans, thresholds, found)
    listed = _closed(heads, _inputs(heads, metrics, window, found.calls, file), F.array_sort(F.collect_list("input")).alias("inputs"))
    return listed.withColumn("inputs", F.when(F.col("n_inputs") > 0, F.col("inputs")).otherwise(F.array().cast(f"array<{INPUT}>"))).select("pod", "metric_type", "kind", "value", "n_samples", "inputs")
