"""Rank semantics, accuracy measures and paired statistics of ranked candidate lists.

Lists are tables (case_id, pos, score, depth, ...); pos is the place in the list, from 1.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def along() -> WindowSpec:
    return Window.partitionBy("case_id").orderBy("pos")


def _changes(*keys: str) -> Column:
    """1 where any key differs from the row before, null-safe, and on the first row."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(along()))
    return F.when((F.row_number().over(along()) == 1) | ~same, 1).otherwise(0)


def dense_rank_runs(lists: DataFrame, *keys: str) -> DataFrame:
    """Adds rank: one more whenever a key changes along the list (an unsorted list can change back)."""
    return lists.withColumn("_step", _changes(*(keys or ("score", "depth")))).withColumn("rank", F.sum("_step").over(along()).cast("int")).drop("_step")


def service_rank(lists: DataFrame, *keys: str) -> DataFrame:
    """The first candidate of each service, then ranked: (case_id, service, pos, rank)."""
    first = Window.partitionBy("case_id", "service").orderBy("pos")
    kept = lists.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return dense_rank_runs(kept, *keys)


def historical_rank(lists: DataFrame) -> DataFrame:
    """(case_id, rank) of the first match by the old counter.

    lists also has matches, is_resource and one_part (whether the truth has one part). The counter starts at 1 and moves on
    at each earlier row that is not tied with the row before it; with one-part truths, resource rows never move it.
    """
    tied = (F.col("score") == F.lag("score").over(along())) & (F.col("depth") == F.lag("depth").over(along()))
    moves = F.when(F.col("one_part") & F.col("is_resource"), 0).when(F.coalesce(tied, F.lit(False)), 0).otherwise(1)
    counted = lists.withColumn("_moves", moves)
    before = along().rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("rank", 1 + F.coalesce(F.sum("_moves").over(before), F.lit(0)))
    hit = F.col("matches") & (F.col("is_resource") | ~F.col("one_part"))
    return counted.filter(hit).groupBy("case_id").agg(F.min_by("rank", "pos").cast("int").alias("rank"))


def action_text(lists: DataFrame, command: str, templates: DataFrame, out: str) -> DataFrame:
    """Adds out: what an action says. A log's is the template of its number (empty without one), an alert's its metric, else
    the command itself. templates: (cluster_id string, template)."""
    kind = F.regexp_extract(command, r"(?s)^(log|alert):(.*)", 1)
    rest = F.regexp_extract(command, r"(?s)^(log|alert):(.*)", 2)
    told = templates.select(F.col("cluster_id").cast("string").alias("_cluster"), F.col("template").alias("_template"))
    joined = lists.join(told, (kind == "log") & (rest == F.col("_cluster")), "left")
    text = F.when(kind == "log", F.coalesce("_template", F.lit(""))).when(kind == "alert", rest).otherwise(F.col(command))
    return joined.withColumn(out, text).drop("_cluster", "_template")


def matches_truth(parts: str = "parts", injected: str = "inject_pod") -> Column:
    """Whether a candidate (pod, resource, src_text, dst_text) is the truth: of one part, a resource that holds it; of two,
    actions whose texts hold them; on the injected pod either way. Truths of other sizes match nothing."""
    there = F.coalesce(F.contains("pod", F.col(injected)), F.lit(False))
    one = F.coalesce(F.contains("resource", F.get(parts, F.lit(0))), F.lit(False))
    two = F.coalesce(F.contains("src_text", F.get(parts, F.lit(0))) & F.contains("dst_text", F.get(parts, F.lit(1))), F.lit(False))
    return F.when(F.size(parts) == 1, one & there).when(F.size(parts) == 2, two & there).otherwise(False)


def evaluated(lists: DataFrame, *keys: str) -> DataFrame:
    """(case_id, n_candidates, rank_inner, rank_service_raw, rank_service_dedup, rank_historical) of every case with candidates.

    lists: (case_id, pos, score, depth, pod, service, resource, src_text, dst_text, parts, inject_pod, inject_service).
    """
    told = lists.withColumn("matches", matches_truth())
    ranked = dense_rank_runs(told, *keys)
    served = F.col("service") == F.col("inject_service")

    def first(hit: Column) -> Column:
        return F.min_by(F.when(hit, F.col("rank")), F.when(hit, F.col("pos")))

    raw = ranked.groupBy("case_id").agg(F.count("*").alias("n_candidates"), first(F.col("matches")).alias("rank_inner"), first(served).alias("rank_service_raw"))
    dedup = service_rank(told, *keys).groupBy("case_id").agg(first(served).alias("rank_service_dedup"))
    counted = historical_rank(told.withColumn("one_part", F.size("parts") == 1).withColumn("is_resource", F.col("resource").isNotNull()))
    return raw.join(dedup, "case_id", "left").join(counted.withColumnRenamed("rank", "rank_historical"), "case_id", "left")


def paired_statistics(pairs: DataFrame, k: int = 1, resamples: int = 10_000, seed: int = 20260820) -> dict[str, float | int | None]:
    """All of one comparison: cases, discordant counts within k and their exact p-value, the mean difference of reciprocal
    ranks and its interval. Only counts reach the driver."""
    row = mcnemar(pairs, k).head()
    gain = F.coalesce(1 / F.col("left_rank"), F.lit(0.0)) - F.coalesce(1 / F.col("right_rank"), F.lit(0.0))
    mean = pairs.agg(F.count("*").alias("n"), F.avg(gain).alias("mean")).head()
    low, high = bootstrap_ci_of(pairs, resamples, seed)
    return {"cases": mean["n"], "b": row["b"], "c": row["c"], "p": mcnemar_p(row["b"], row["c"]), "mean_difference": mean["mean"], "low": low, "high": high}


def accuracy(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row over (case_id, rank): cases, AC@k in percent, mean reciprocal rank, localized and not. Null rank: not localized."""
    hits = [(100.0 * F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"ac_at_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("cases"), *hits, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("rank").alias("localized"), F.count_if(F.col("rank").isNull()).alias("unlocalized"))


def candidate_sizes(lists: DataFrame, cases: DataFrame) -> DataFrame:
    """(min, median, max) of list lengths over all cases; the median is the upper one."""
    sizes = cases.select("case_id").join(lists.groupBy("case_id").agg(F.count("*").alias("n")), "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    counted = sizes.groupBy("n").agg(F.count("*").alias("cases"))
    total = sizes.agg(F.count("*")).scalar()
    upto = counted.withColumn("upto", F.sum("cases").over(Window.orderBy("n")))
    return upto.agg(F.min("n").alias("min_size"), F.min(F.when(F.col("upto") > F.floor(total / 2), F.col("n"))).alias("median_size"), F.max("n").alias("max_size"))


def by_fault_class(ranks: DataFrame) -> DataFrame:
    """(fault_class, cases, hits_at_1)."""
    return ranks.groupBy("fault_class").agg(F.count("*").alias("cases"), F.count_if(F.col("rank") == 1).alias("hits_at_1"))


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_rank, right_rank); a key that comes twice on a side raises."""

    def once(df: DataFrame, name: str) -> DataFrame:
        grouped = df.groupBy(*keys).agg(F.count("*").alias("n"), F.first("rank").alias(name))
        bad = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("key comes twice: "), F.concat_ws("/", *keys))).cast("int"))
        return grouped.select(*keys, F.coalesce(bad, F.col(name)).cast("int").alias(name))

    return once(left, "left_rank").join(once(right, "right_rank"), keys)


def mcnemar(pairs: DataFrame, k: int = 1) -> DataFrame:
    """(b, c): cases that only the left, and only the right, has within k."""
    x, y = (F.coalesce(F.col(c) <= k, F.lit(False)) for c in ("left_rank", "right_rank"))
    return pairs.agg(F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p-value of b and c discordant pairs."""
    tail = sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)
    return min(1.0, 2 * tail)


def bootstrap_ci_of(pairs: DataFrame, resamples: int = 10_000, seed: int = 20260820) -> tuple[float | None, float | None]:
    """Interval of 95 % of the mean difference of reciprocal ranks, over all rows of (left_rank, right_rank); a null rank
    counts 0.

    Only the distinct pairs of ranks and their counts reach the driver: a resample of n cases is a multinomial draw from them.
    """
    counted = pairs.groupBy("left_rank", "right_rank").agg(F.count("*").alias("n")).orderBy("left_rank", "right_rank").collect()
    if not counted:
        return None, None
    value = np.array([(1 / r["left_rank"] if r["left_rank"] else 0.0) - (1 / r["right_rank"] if r["right_rank"] else 0.0) for r in counted])
    n = np.array([r["n"] for r in counted])
    rng = np.random.Generator(np.random.PCG64(seed))
    means = np.sort(np.concatenate([rng.multinomial(n.sum(), n / n.sum(), min(500, resamples - at)) @ value for at in range(0, resamples, 500)]) / n.sum())
    return float(means[int(0.025 * resamples)]), float(means[int(0.975 * resamples) - 1])
