"""Differential root-cause ranking: pairs of actions that normal sessions show and abnormal ones lack.

Actions are text keys screen|command|args (see graph.labelled). Positions of first encounter are explicit columns,
because the order in which pairs were met decides ties.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScoreConfig
from ..sources.scratch import staged
from .graph import pairs

#: The percentile of latencies; the size of its sketch (a place off by some 0.0013 of the samples at most, with a chance of
#: 99 %), the share of samples between it and a bound, and up to how many samples a pod needs no bounds.
P90, SKETCH, NEAR, FEW = 0.9, 4096, 0.003, 10_000


def pair_support(acts: DataFrame) -> DataFrame:
    """(src, dst, n, first_at): occurrences of neighbouring pairs, and the place of the first."""
    return pairs(acts).groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("_ord").alias("first_at"))


def differential_scores(normal: DataFrame, abnormal: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """(src, dst, n, a, score, first_at) of pairs frequent in normal sessions: 1 if abnormal ones lack it, else n / (n + a)."""
    seen = abnormal.select("src", "dst", F.col("n").alias("a"))
    both = normal.filter(F.col("n") > config.min_normal).join(seen, ["src", "dst"], "left")
    scored = both.withColumn("score", F.when(F.col("a").isNull(), 1.0).otherwise(F.col("n") / (F.col("n") + F.col("a"))))
    return scored.filter(F.col("score") >= config.keep).select("src", "dst", "n", F.coalesce("a", F.lit(0)).alias("a"), "score", "first_at")


def is_alert(key: str):
    return F.split(F.col(key), r"\|")[1].startswith("alert:")


def root_most(scores: DataFrame) -> DataFrame:
    """Drops a pair whose source is the target of a pair that scores as high, judged on all scores before dropping.

    The highest score into each action decides, so that an aggregate and an equi-join replace a join with a range.
    """
    into = scores.groupBy("dst").agg(F.max("score").alias("best")).select(F.col("dst").alias("src"), "best")
    return scores.join(into, "src", "left").filter(is_alert("dst") | F.col("best").isNull() | (F.col("score") > F.col("best"))).drop("best")


def deepest(acts: DataFrame) -> DataFrame:
    """(action, depth, session_id, _ord): the deepest occurrence of each action; depth is 1 and the spans before it.

    Of equally deep ones the first in source order counts.
    """
    before = Window.partitionBy("session_id").orderBy("action_idx").rowsBetween(Window.unboundedPreceding, -1)
    spans = F.col("command_id").startswith("span:").cast("bigint")
    placed = acts.withColumn("depth", 1 + F.coalesce(F.sum(spans).over(before), F.lit(0)))
    best = F.min_by(F.struct("session_id", "_ord", "depth"), F.struct(-F.col("depth"), "_ord"))
    return placed.groupBy("action").agg(best.alias("b")).select("action", "b.depth", "b.session_id", "b._ord")


def attributed(scores: DataFrame, acts: DataFrame, pods: DataFrame) -> DataFrame:
    """Scores with depth, session and pod of their source's deepest occurrence; pods is (_ord, pod). Without a pod: dropped."""
    placed = scores.join(deepest(acts).withColumnRenamed("action", "src"), "src").join(pods.filter("pod <> ''"), "_ord")
    return placed.select("src", "dst", "score", "depth", "session_id", "pod", "first_at")


def first_alarms(alarms: DataFrame) -> DataFrame:
    """(pod, resource): the first alarm of each pod, by the column position where there is one, else by resource."""
    order = "position" if "position" in alarms.columns else "resource"
    return alarms.groupBy("pod").agg(F.min_by("resource", F.struct(order, "resource")).alias("resource"))


def alarm_dedup(candidates: DataFrame, alarms: DataFrame) -> DataFrame:
    """Of a pod's alarmed candidates only the first of those at the pod's greatest depth stays, with the pod's first alarm
    as its resource. alarms: (pod, resource) and, where a pod has several, position."""
    marked = candidates.join(first_alarms(alarms), "pod", "left")
    pod = Window.partitionBy("pod").orderBy(F.desc("depth"), "first_at", "src", "dst")
    return marked.withColumn("place", F.row_number().over(pod)).filter(F.col("resource").isNull() | (F.col("place") == 1)).drop("place")


def ranked(candidates: DataFrame, with_anomaly: bool = False) -> DataFrame:
    """Adds pos: best score, (least usual,) deepest first; equal ones as they were met."""
    keys = [F.desc("score"), *([F.desc("anomaly_score")] if with_anomaly else []), F.desc("depth"), F.col("first_at"), F.col("src"), F.col("dst")]
    by = [c for c in ("case_id",) if c in candidates.columns]
    return candidates.withColumn("pos", F.row_number().over(Window.partitionBy(*by, F.lit(0) if not by else by[0]).orderBy(*keys)))


def root_causes(normal: DataFrame, abnormal: DataFrame, pods: DataFrame, alarms: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """The whole ranking of one case, from the supports of neighbouring pairs."""
    scores = root_most(differential_scores(pair_support(normal), pair_support(abnormal), config))
    return ranked(alarm_dedup(attributed(scores, normal, pods), alarms))


def edge_supports(normal_edges: DataFrame, abnormal_edges: DataFrame) -> DataFrame:
    """(src, dst, n, a, anomaly_score) of the edges of the normal graph: their frequency there and in the abnormal graph (0 if
    it lacks them), and their anomaly in the normal one. Edges of the abnormal graph alone are left out."""
    seen = abnormal_edges.select("src", "dst", F.col("frequency").alias("a"))
    both = normal_edges.select("src", "dst", F.col("frequency").alias("n"), "anomaly_score").join(seen, ["src", "dst"], "left")
    return both.select("src", "dst", "n", F.coalesce("a", F.lit(0)).alias("a"), "anomaly_score")


def edge_scores(supports: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """supports with score, of the edges frequent enough in the normal graph that score enough: see differential_scores."""
    score = F.when(F.col("a") == 0, 1.0).otherwise(F.col("n") / (F.col("n") + F.col("a")))
    return supports.filter(F.col("n") > config.min_normal).withColumn("score", score).filter(F.col("score") >= config.keep)


def witnessed(scores: DataFrame, normal: DataFrame) -> DataFrame:
    """scores with first_at, the place where the normal scenarios first show the pair.

    Ties are decided by that place, so a scored pair without one means that graph and scenarios are of different data:
    the job fails instead of ranking by chance.
    """
    places = pair_support(normal).select("src", "dst", "first_at")
    told = scores.join(places, ["src", "dst"], "left")
    missing = F.raise_error(F.concat(F.lit("a scored edge is not met in the normal scenarios: "), "src", F.lit(" to "), "dst"))
    return told.withColumn("first_at", F.when(F.col("first_at").isNull(), missing.cast(places.schema["first_at"].dataType)).otherwise(F.col("first_at")))


def graph_root_causes(normal: DataFrame, pods: DataFrame, alarms: DataFrame, normal_edges: DataFrame, abnormal_edges: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """The ranking of one case from its two graphs, which alone give supports and anomaly scores; the normal scenarios give
    places, depths and pods. Anomaly breaks ties of score before depth does."""
    scores = edge_scores(edge_supports(normal_edges, abnormal_edges), config)
    placed = attributed(witnessed(root_most(scores), normal), normal, pods)
    return ranked(alarm_dedup(placed.join(scores.select("src", "dst", "anomaly_score"), ["src", "dst"]), alarms), with_anomaly=True)


class Latency(NamedTuple):
    """Of the same spans: calls as of latency_pairs, p90 as of latency_p90. For callers that read both, or one twice."""

    calls: DataFrame
    p90: DataFrame


def latency(spans: DataFrame, fallback: float = 10.0) -> Latency:
    calls = latency_pairs(spans)
    return Latency(calls, percentiles(calls, fallback))


def latency_pairs(spans: DataFrame) -> DataFrame:
    """(pod, child_row, parent_row, ms): calls from other pods and (parent end - child end) in milliseconds.

    spans: (row, span_id, parent_id, pod, end_ns). A span id given twice is the later row. Parents are staged, so that their
    size is known: few of them are broadcast, and the spans are not shuffled.
    """
    last = F.max_by(F.struct("pod", "end_ns", "row"), "row").alias("p")
    parents = spans.groupBy("span_id").agg(last).select(F.col("span_id").alias("parent_id"), F.col("p.pod").alias("parent_pod"), F.col("p.end_ns").alias("parent_end"), F.col("p.row").alias("parent_row"))
    calls = spans.join(staged(parents, "span-parents"), "parent_id").filter("parent_pod <> pod")
    return calls.select("pod", F.col("row").alias("child_row"), "parent_row", ((F.col("parent_end") - F.col("end_ns")) / 1_000_000).alias("ms"))


def pod_latency(spans: DataFrame, thresholds: DataFrame, pods: DataFrame, fallback: float = 10.0, found: Latency | None = None) -> DataFrame:
    """(pod, n_samples, p90, source) of every pod: from its calls; without a span of its own from its service's threshold.

    thresholds: (service, value); pods: (pod, service). source: trace-derived-p90 or fallback-threshold. found: the latency of
    these spans, with this fallback, where the caller has it.
    """
    seen = spans.select("pod").distinct().withColumn("seen", F.lit(True))
    p90 = found.p90 if found else latency_p90(spans, fallback)
    joined = pods.join(seen, "pod", "left").join(p90, "pod", "left").join(thresholds, "service", "left")
    own = F.col("seen").isNotNull()
    return joined.select("pod", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.when(own, F.coalesce("p90", F.lit(fallback))).otherwise(F.col("value")).alias("p90"), F.when(own, "trace-derived-p90").otherwise("fallback-threshold").alias("source"))


def latency_p90(spans: DataFrame, fallback: float = 10.0) -> DataFrame:
    """(pod, n_samples, p90): interpolated percentile of the latency_pairs; two samples or fewer give the fallback."""
    return latency(spans, fallback).p90


def percentiles(calls: DataFrame, fallback: float = 10.0, near: float = NEAR, few: int = FEW) -> DataFrame:
    """(pod, n_samples, p90) of latency_pairs, exact, with no task that holds a pod's samples.

    A sketch gives two values around the percentile: samples below the lower one are only counted, those between are counted
    by value. A pod whose percentile is not between them is counted by value as a whole, as are pods of few samples.
    """
    sketch = F.kll_sketch_agg_double(F.col("ms").cast("double"), F.lit(SKETCH))
    sized = calls.groupBy("pod").agg(F.count("*").alias("n_samples"), F.count("ms").alias("n"), sketch.alias("sketch"))
    low, high = (F.when(F.col("n") > few, F.kll_sketch_get_quantile_double("sketch", F.lit(place))) for place in (P90 - near, P90 + near))
    bounds = staged(sized.select("pod", "n_samples", "n", low.alias("low"), high.alias("high")), "latency-bounds")
    found = staged(_between(calls, bounds), "latency-p90")
    missed = bounds.filter("low IS NOT NULL").join(found, "pod", "left_anti")
    if missed.head(1):
        none = F.lit(None).cast("double")
        found = found.unionByName(staged(_between(calls, missed.withColumns({"low": none, "high": none})), "latency-p90"))
    return bounds.join(found, "pod", "left").select("pod", "n_samples", F.when(F.col("n_samples") > 2, F.col("p90")).otherwise(fallback).alias("p90"))


def _between(calls: DataFrame, bounds: DataFrame) -> DataFrame:
    """(pod, p90) of the pods whose percentile is between their bounds (pod, n, low, high; null: no bound)."""
    kept = calls.join(bounds, "pod").filter("ms IS NOT NULL AND (high IS NULL OR ms <= high)")
    counts = kept.groupBy("pod", "n", F.expr("CASE WHEN low IS NULL OR ms >= low THEN ms END").alias("ms")).agg(F.count("*").alias("times"))
    rising = Window.partitionBy("pod").orderBy(F.asc_nulls_first("ms")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("upto", F.sum("times").over(rising)).withColumn("at", (F.col("n") - 1) * F.lit(P90))
    floor, ceil = F.floor("at"), F.ceil("at")
    # null where it is among the samples below, or beyond those counted
    ends = placed.groupBy("pod", "at").agg(*(F.min_by("ms", F.when(F.col("upto") > place, F.col("upto"))).alias(name) for name, place in (("less", floor), ("more", ceil))))
    mixed = (ceil - F.col("at")) * F.col("less") + (F.col("at") - floor) * F.col("more")
    return ends.filter("less IS NOT NULL AND more IS NOT NULL").select("pod", F.when(F.col("less") == F.col("more"), F.col("less")).otherwise(mixed).alias("p90"))
