"""Mixing of sources to target weights by a time-varying curriculum, with DataFrame functions only.

1. Targets. A source's share follows its weight; no target exceeds ``most`` times the source's size, and what is over is
   shared out again by weight. In the order of size per weight the bounded sources come first, so one running sum finds
   the level at which the rest stand.
2. Streams. The documents of a source, in the order of a hash of their id, follow each other as one stream of words,
   pass after pass; the mix takes the stream's first words up to the target. A document may be cut at the stream's end.
3. Time. Each weight has a schedule: its height over training time 0 to 1, linear between knots. Its integral, scaled to
   1, tells which part of a source's target is demanded by which time; inverted at a document's place in the stream, it
   gives the time at which the document is due, and the demand of all sources by then is its position in training.
4. Order. Documents are range-sorted by position.

Scale: running sums go in two levels. A source's documents fall into SLICES slices by their hash, and a window covers the
slices of a source (a bounded number) or the documents of one slice, never a whole source; sums over sources go by
ranges. Only totals reach the driver: one row, and one per weight.

Edge cases: a null text has no words and size 0, and nothing is taken of it; a null source is a source, the last; null and
repeated ids are documents of their own; rows of equal id and source follow by size, rows equal in all three are
interchangeable, so reruns agree; a very long text is counted whole and may be cut in the mix; sources of no words have
target 0; documents of which nothing is taken have no position and come last; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table

#: Weights of the sources in turn; words of the mix per word there is; times that a source or document may be taken.
WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
#: Of each weight the knots (time, height) of its schedule: heavy sources lead, light ones come late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))
#: Slices of a source, as hexadecimal digits of the hash.
SLICE_DIGITS = 3


def demanded(t: Column, knots) -> Column:
    """The schedule's integral from 0 to t, with a whole of 1."""
    whole, at, out = _mass(knots), 0.0, F.lit(1.0)
    parts = []
    for (t0, h0), (t1, h1) in zip(knots, knots[1:]):
        slope = (h1 - h0) / (t1 - t0)
        parts.append((t1, (F.lit(at) + (t - t0) * (F.lit(h0) + (t - t0) * (slope / 2))) / whole))
        at += (t1 - t0) * (h0 + h1) / 2
    for t1, value in reversed(parts):
        out = F.when(t < t1, value).otherwise(out)
    return out


def due(part: Column, knots) -> Column:
    """The time by which that part (0 to 1) of the demand has come: the inverse of demanded()."""
    whole, at, out = _mass(knots), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, h0), (t1, h1) in zip(knots, knots[1:]):
        end = at + (t1 - t0) * (h0 + h1) / 2
        rest, double_slope = part * whole - at, 2 * (h1 - h0) / (t1 - t0)
        root = F.lit(h0) + F.sqrt(F.greatest(F.lit(h0 * h0) + rest * double_slope, F.lit(0.0)))
        pieces.append((end, F.lit(t0) + F.when(root > 0, rest * 2 / root).otherwise(0.0)))
        at = end
    for end, value in reversed(pieces):
        out = F.when(part * whole < end, value).otherwise(out)
    return out


def _mass(knots) -> float:
    return sum((t1 - t0) * (h0 + h1) / 2 for (t0, h0), (t1, h1) in zip(knots, knots[1:]))


def running(df: DataFrame, order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """df with columns that sum what lies before each row in a total order: within its range, and the ranges before.

    Nothing but one row for each range (of which there are as many as shuffle partitions) meets in one task.
    """
    ranged = staged(df.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy("_range").agg(*(F.sum(f"_{k}").alias(f"_all_{k}") for k in sums))
    ahead = ahead.select("_range", *(F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_ahead_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(ahead), "_range")
    out = out.withColumns({k: F.col(f"_ahead_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    return out.select(*df.columns, *sums)


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """sources (key, source, source_size) with turn (whose weight it has), weight and target. Staged."""
    turns = running(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "source-turns")
    turns = turns.withColumn("turn", F.col("place") % len(weights)).drop("place")
    turns = turns.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("turn").cast("int"))).withColumn("cap", most * F.col("source_size"))
    turns = turns.withColumn("height", F.col("cap") / F.col("weight"))
    levels = running(turns, [F.col("height"), F.col("key")], {"caps": F.col("cap"), "taken_weights": F.col("weight")}, "source-levels")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).head()["words"]
    all_weights = levels.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).head()["w"]
    level = (F.lit(budget * total) - F.col("caps")) / (F.lit(all_weights) - F.col("taken_weights"))
    free = levels.withColumn("level", level).filter(F.col("level") * F.col("weight") < F.col("cap"))
    stands = free.agg(F.min_by("level", F.struct("height", "key")).alias("level")).head()["level"]
    target = F.col("cap").cast("double") if stands is None else F.least(F.col("cap").cast("double"), F.lit(stands) * F.col("weight"))
    return staged(levels.select("key", "source", "source_size", "turn", "weight", target.alias("target")), "source-targets")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, budget: float = BUDGET, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, weight, target, taken, and passes, an array of
    (pass, words, due, position) of the times it is taken. Staged."""
    if len(weights) != len(schedules) or min(weights) <= 0 or any(k[0][0] != 0 or k[-1][0] != 1 or _mass(k) <= 0 for k in schedules):
        raise ValueError("each weight is positive and has a schedule over the times 0 to 1 with some height")
    source = F.col(source_col).cast("string")
    hashed = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    # A key that is never null, so that joins and windows share one partitioning.
    sized = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), hashed.alias("hash"), F.substring(hashed, 1, SLICE_DIGITS).alias("slice"), size.alias("size"))
    sized = staged(sized, "mix-sizes")
    slices = staged(sized.groupBy("key", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("slice_size")), "mix-slices")
    sources = source_targets(staged(slices.groupBy("key").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size")), "mix-sources"), weights, budget, most)

    goal = F.floor(F.col("target") + 0.5)
    wanted = {r["turn"]: r["words"] for r in sources.groupBy("turn").agg(F.sum(goal).alias("words")).collect()}  # a row for each weight
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = slices.select("key", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("ahead")).join(sources.drop("source"), "key")
    inside = Window.partitionBy("key", "slice").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(ahead, ["key", "slice"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("goal", goal)

    def at_turn(f) -> Column:
        return reduce(lambda out, k: F.when(F.col("turn") == k, f(schedules[k])).otherwise(out), range(1, len(weights)), f(schedules[0]))

    def one(k: int) -> Column:
        start = F.col("start") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - start))
        return F.when(words > 0, F.struct(F.lit(k).alias("pass"), words.alias("words"), at_turn(lambda knots: due(start / F.col("goal"), knots)).alias("due")))

    passes = F.filter(F.array(*map(one, range(most))), lambda p: p.isNotNull())
    placed = placed.withColumn("passes", passes)

    def position(p: Column) -> Column:
        return F.floor(reduce(lambda a, b: a + b, (F.lit(float(wanted.get(k, 0))) * demanded(p["due"], knots) for k, knots in enumerate(schedules)))).cast("long")

    placed = placed.withColumn("passes", F.transform("passes", lambda p: F.struct(p["pass"], p["words"], p["due"], position(p).alias("position"))))
    taken = F.aggregate(F.col("passes"), F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return staged(placed.select("doc_id", "source", "size", "source_size", "weight", "target", taken.alias("taken"), "passes"), "mix")


def training_order(mixed: DataFrame) -> DataFrame:
    """(position, doc_id, source, pass, words, due): each time that a document is taken, range-sorted by position."""
    rows = mixed.select("doc_id", "source", F.explode("passes").alias("p")).select("p.position", "doc_id", "source", "p.pass", "p.words", "p.due")
    return rows.orderBy("position", "source", "doc_id", "pass")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first place in training; position and again_at are those of the two passes."""
    mixed = mix(table(spark, sf_dir, "documents"))
    first, again = F.get("passes", F.lit(0))["position"], F.get("passes", F.lit(1))["position"]
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), again.alias("again_at"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")
