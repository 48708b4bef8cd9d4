"""Data-quality gates: each returns the offending rows, so that an empty table passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def bijection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, missing_in): keys that one side lacks."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(b.join(a, keys, "left_anti").withColumn("missing_in", F.lit("left")))


def multiset_difference(left: DataFrame, right: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """(columns, only_in): rows that one side has more often, without the dropped columns."""
    a, b = left.drop(*drop), right.drop(*drop)
    b = b.select(a.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def conservation(counters: DataFrame, equations: dict[str, tuple[str, list[tuple[int, str]]]]) -> DataFrame:
    """(problem, expected, found): equations name: (counter, signed sum of counters) over a table (name, value).

    A counter that is not there is a violation, not a zero.
    """
    names = sorted({c for left, right in equations.values() for c in [left, *(n for _, n in right)]})
    row = counters.groupBy().pivot("name", names).agg(F.first("value"))

    def checked(problem: str, left: str, right: list[tuple[int, str]]) -> DataFrame:
        expected = reduce(lambda a, b: a + b, (F.lit(s) * F.col(f"`{n}`") for s, n in right))
        return row.select(F.lit(problem).alias("problem"), expected.cast("bigint").alias("expected"), F.col(f"`{left}`").cast("bigint").alias("found")).filter(~F.col("expected").eqNullSafe(F.col("found")) | F.col("expected").isNull())

    return reduce(DataFrame.unionByName, (checked(k, *v) for k, v in equations.items()))


def provenance_walk(candidates: DataFrame, events: DataFrame, provenance: DataFrame, sources: DataFrame) -> DataFrame:
    """(session_id, seq, reason): candidates whose way to a source row breaks, and where.

    candidates, events and provenance share (session_id, seq); provenance and sources share (file, row).
    """
    keys = ["session_id", "seq"]
    walked = (
        candidates.select(*keys).distinct()
        .join(events.select(*keys).distinct().withColumn("in_events", F.lit(True)), keys, "left")
        .join(provenance.select(*keys, "file", "row").withColumn("in_provenance", F.lit(True)), keys, "left")
        .join(sources.select("file", "row").distinct().withColumn("in_sources", F.lit(True)), ["file", "row"], "left")
    )
    reason = F.when(F.col("in_events").isNull(), "no event").when(F.col("in_provenance").isNull(), "no provenance").when(F.col("in_sources").isNull(), "no source row")
    return walked.withColumn("reason", reason).filter("reason is not null").select(*keys, "reason")


def order_stability(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_pos, second_pos): candidates that two runs put at different places; null where a run lacks one.

    first and second are ranked lists with a column pos, in which the keys name a candidate once.
    """
    a, b = (df.select(*keys, F.col("pos").alias(name)) for df, name in ((first, "first_pos"), (second, "second_pos")))
    return a.join(b, keys, "full").filter(~F.col("first_pos").eqNullSafe(F.col("second_pos")))


def manifest_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, status): missing or unexpected."""
    a, b = expected.select(key).distinct().withColumn("x", F.lit(True)), found.select(key).distinct().withColumn("y", F.lit(True))
    return a.join(b, key, "full").filter("x is null or y is null").select(key, F.when(F.col("y").isNull(), "missing").otherwise("unexpected").alias("status"))
