"""Global alignment of sessions and nearest-session search.

Costs: 0 for equal labels (kind and identifier), 0.4 for the same kind, 1.0 otherwise, 0.6 for an insertion or deletion;
pairs of labels may have costs of their own, which hold both ways. The dynamic programme runs inside an Arrow function, one
pair of sessions a row, so that Spark deals the pairs out.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import event_label
from ..sources.scratch import staged

SAME_KIND, OTHER, GAP = 0.4, 1.0, 0.6
RESULT = "struct<cost:double,matches:int,ops:int,a_len:int,b_len:int,script:string>"


#: Costs in fifths, so that those without overrides are whole numbers and ties are exact.
UNIT = 5


def align_labels(a: list[str], b: list[str], overrides: dict[tuple[str, str], float] | None = None, limit: float | None = None) -> tuple[float, str] | None:
    """(cost, script): least cost and, from left to right, M(atch), S(ubstitute), D(elete), I(nsert) of a best alignment.

    Among best ways back, the diagonal comes first, then deletion, then insertion. Rows are vectors; of n rows every
    root of n-th is kept and those between are made again on the way back, so that two sessions of n and m events take
    memory of about m times the root of n.

    With a limit the answer is None if the cost exceeds it. Each gap costs GAP, so an alignment within the limit strays no
    farther from the diagonal than limit / GAP places, and only that band is computed.
    """
    band = None if limit is None else math.floor(limit / GAP + 1e-9)
    if band is not None and abs(len(a) - len(b)) > band:
        return None
    n, m = len(a), len(b)
    labels, back = np.unique(np.array([*a, *b], object).astype(str), return_inverse=True) if n + m else (np.zeros(0, str), np.zeros(0, np.int64))
    _, kinds = np.unique([x.split(":", 1)[0] for x in labels.tolist()], return_inverse=True) if n + m else (None, np.zeros(0, np.int64))
    rows, columns = back[:n], back[n:]
    gap, other, same = round(GAP * UNIT), round(OTHER * UNIT), round(SAME_KIND * UNIT)
    kind = np.int64 if not overrides else np.float64
    near = 0 if not overrides else 1e-9 * (n + m + 1)

    def costs(i: int, low: int, high: int) -> np.ndarray:
        """Of row i with columns low to high."""
        some = columns[low:high]
        out = np.where(some == rows[i], 0, np.where(kinds[some] == kinds[rows[i]], same, other)).astype(kind)
        both = [((y, x), cost) for (x, y), cost in (overrides or {}).items()] + list((overrides or {}).items())
        for (one, two), cost in both:  # those that are given this way round come last and win
            if one == a[i]:
                out[labels[some] == two] = cost * UNIT
        return out

    steps = gap * np.arange(m + 1, dtype=kind)
    far = kind(UNIT * 4 * (n + m + 1) * max(1.0, *(overrides or {"": 0.0}).values()))  # more than any alignment costs

    def after(i: int, row: np.ndarray) -> np.ndarray:
        """Row i + 1 from row i: the way from the left is a running minimum once the gaps are taken off."""
        if band is None:
            best = row + gap
            best[1:] = np.minimum(best[1:], row[:-1] + costs(i, 0, m))
            return np.minimum.accumulate(best - steps) + steps
        low, high = max(0, i + 1 - band), min(m, i + 1 + band)
        best, from_ = row[low : high + 1] + gap, max(low, 1)
        best[from_ - low :] = np.minimum(best[from_ - low :], row[from_ - 1 : high] + costs(i, from_ - 1, high))
        out = np.full_like(row, far)
        out[low : high + 1] = np.minimum.accumulate(best - steps[low : high + 1]) + steps[low : high + 1]
        return out

    every = max(1, math.isqrt(n))
    kept, row = [steps], steps
    for i in range(n):
        row = after(i, row)
        if (i + 1) % every == 0:
            kept.append(row)
    script, j, total = [], m, float(row[m]) / UNIT
    if limit is not None and total > limit + 1e-9:
        return None
    i, low, block = n, n + 1, []
    while i or j:
        if i and i - 1 < low:
            low = (i - 1) // every * every
            block = [kept[low // every]]
            for k in range(low, i):
                block.append(after(k, block[-1]))
        here = block[i - low] if i else steps
        cost = costs(i - 1, 0, m) if i and j else None
        while j and i and abs(here[j] - block[i - 1 - low][j - 1] - cost[j - 1]) > near and abs(here[j] - block[i - 1 - low][j] - gap) > near:
            j -= 1
            script.append("I")
        if i and j and abs(here[j] - block[i - 1 - low][j - 1] - cost[j - 1]) <= near:
            script.append("M" if cost[j - 1] == 0 else "S")
            i, j = i - 1, j - 1
        elif i:
            i -= 1
            script.append("D")
        else:
            script.append("I" * j)
            j = 0
    return total, "".join(reversed(script))


def session_labels(events: DataFrame) -> DataFrame:
    """(session_id, labels): event labels in source order."""
    listed = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("_ord", event_label().alias("label")))).alias("s"))
    return listed.select("session_id", F.transform("s", lambda x: x["label"]).alias("labels"))


def aligned(pairs: DataFrame, overrides: dict[tuple[str, str], float] | None = None, limit: str | None = None) -> DataFrame:
    """Adds to pairs with array columns a and b: cost, matches, ops, match_rate, similarity, script. With limit, a column
    of the greatest cost of interest, these are null where the cost is greater."""

    @F.pandas_udf(RESULT)
    def run(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, z in zip(a, b, most):
            found = align_labels(list(x), list(y), overrides, z if limit else None)
            rows.append((found[0], found[1].count("M"), len(found[1]), len(x), len(y), found[1]) if found else (None,) * 6)
        return pd.DataFrame(rows, columns=["cost", "matches", "ops", "a_len", "b_len", "script"]).astype({c: "Int64" for c in ("matches", "ops", "a_len", "b_len")})

    out = pairs.withColumn("r", run("a", "b", F.col(limit) if limit else F.lit(0.0)))
    longest = F.greatest("r.a_len", "r.b_len")
    return out.select(*pairs.columns, "r.cost", "r.matches", "r.ops", F.when(F.col("r.ops") == 0, 1.0).otherwise(F.col("r.matches") / F.col("r.ops")).alias("match_rate"), F.when(longest == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("r.cost") / longest)).alias("similarity"), "r.script")


def align_sessions(events: DataFrame, a: str, b: str, overrides: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """One row for two sessions; a session without events raises LookupError."""
    labels = session_labels(events.filter(F.col("session_id").isin(a, b)))
    found = {r["session_id"] for r in labels.select("session_id").collect()}
    if missing := {a, b} - found:
        raise LookupError(f"no such session: {', '.join(sorted(missing))}")
    left = labels.filter(F.col("session_id") == a).select(F.col("session_id").alias("session_a"), F.col("labels").alias("a"))
    right = labels.filter(F.col("session_id") == b).select("labels")
    return aligned(left.withColumn("session_b", F.lit(b)).withColumn("b", right.scalar()), overrides).drop("a", "b")


def least_costs(events: DataFrame, probe: str, overrides: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """(session_id, session_ord, longest, least_cost, most_similar): what aligning each other session with the probe costs at
    the least, from counts alone.

    Whatever the order, no more events can match than the labels have in common, nor more be of the same kind than the kinds
    have; all other pairs are unlike, and what one session is longer by are gaps. An override may make any pair of unlike
    labels as cheap as itself.
    """
    cheapest = min([OTHER, *(overrides or {}).values()])
    labelled = events.select("session_id", "_ord", event_label().alias("label"))
    counted = labelled.groupBy("session_id", "label").agg(F.count("*").alias("n"), F.min("_ord").alias("first"))
    counted = staged(counted.withColumn("kind", F.split("label", ":")[0]), "label-counts")
    mine = counted.filter(F.col("session_id") == probe)
    by_label = mine.select("label", F.col("n").alias("own"))
    by_kind = mine.groupBy("kind").agg(F.sum("n").alias("own"))
    met = counted.filter(F.col("session_id") != probe).join(by_label, "label", "left")
    kinds = met.groupBy("session_id", "kind").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("own", F.lit(0)))).alias("equal"), F.min("first").alias("first"))
    both = kinds.join(by_kind, "kind", "left").groupBy("session_id").agg(
        F.min("first").alias("session_ord"), F.sum("n").alias("n"), F.sum("equal").alias("equal"), F.sum(F.least("n", F.coalesce("own", F.lit(0)))).alias("alike")
    )
    both = both.withColumn("m", mine.agg(F.sum("n")).scalar())
    pairs, longest = F.least("n", "m"), F.greatest("n", "m")
    fifths = (F.col("alike") - F.col("equal")) * (UNIT * min(SAME_KIND, cheapest)) + (pairs - F.col("alike")) * (UNIT * cheapest) + (longest - pairs) * (UNIT * GAP)
    out = both.withColumn("least_cost", fifths / UNIT).withColumn("longest", longest)
    return out.select("session_id", "session_ord", "longest", "least_cost", _similarity(F.col("least_cost"), F.col("longest")).alias("most_similar"))


def _similarity(cost, longest):
    return F.when(longest == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - cost / longest))


class Nearest(NamedTuple):
    """The nearest sessions, and how many sessions there were and how many of them were aligned."""

    found: DataFrame
    sessions: int
    aligned: int


def nearest_counted(events: DataFrame, probe: str, top_n: int, overrides: dict[tuple[str, str], float] | None = None, first: int = 4) -> Nearest:
    """As nearest(), with counts.

    Sessions are taken in the order of how similar they can be at most, ``first`` times top_n of them and then four times
    as many in each round, until none left can reach the similarity of the top_n-th found. That bar also bounds the cost
    of interest, and with it the band of each alignment. A round is a job; only top_n rows of it reach the driver.
    """
    spark = events.sparkSession
    labels = staged(session_labels(events), "session-labels")
    asked = labels.filter(F.col("session_id") == probe).select(F.col("labels").alias("a"))
    kind = "session_id string, session_ord {}, cost double, match_rate double, similarity double"
    bounds = staged(least_costs(events, probe, overrides), "least-costs") if asked.head(1) and top_n > 0 else None
    kind = kind.format(events.schema["_ord"].dataType.simpleString())
    best: list = []
    sessions = bounds.count() if bounds is not None else 0
    done, bar, batch, ceiling = 0, 0.0, first * top_n, None
    while bounds is not None:
        left = bounds.filter(F.col("most_similar") >= bar)
        left = left if ceiling is None else left.filter(F.col("most_similar") < ceiling)
        floor = left.orderBy(F.desc("most_similar")).limit(batch).agg(F.min("most_similar")).head()[0]
        if floor is None:
            break
        part = left.filter(F.col("most_similar") >= floor)
        done += part.count()
        pairs = part.join(labels.withColumnRenamed("labels", "b"), "session_id").withColumn("a", asked.scalar())
        pairs = pairs.withColumn("most", (1 - F.lit(bar)) * F.col("longest") + 1e-6)
        scored = aligned(pairs, overrides, "most").filter("cost is not null").select("session_id", "session_ord", "cost", "match_rate", "similarity")
        best += scored.orderBy(F.desc("similarity"), "session_ord").limit(top_n).collect()
        best = sorted(best, key=lambda r: (-r["similarity"], r["session_ord"]))[:top_n]
        bar = best[-1]["similarity"] if len(best) == top_n else 0.0
        ceiling, batch = floor, batch * 4
    found = spark.createDataFrame([tuple(r) for r in best], kind).orderBy(F.desc("similarity"), "session_ord")
    return Nearest(found.select("session_id", "cost", "match_rate", "similarity"), sessions, done)


def nearest(events: DataFrame, probe: str, top_n: int, overrides: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """(session_id, cost, match_rate, similarity) of the sessions most like the probe, which is left out itself."""
    return nearest_counted(events, probe, top_n, overrides).found


def nearest_by_scan(events: DataFrame, probe: str, top_n: int, overrides: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """The same rows, with every session aligned."""
    labels = session_labels(events)
    mine = labels.filter(F.col("session_id") == probe).select("labels")
    order = events.groupBy("session_id").agg(F.min("_ord").alias("session_ord"))
    others = labels.filter(F.col("session_id") != probe).withColumnRenamed("labels", "b").withColumn("a", mine.scalar()).filter("a is not null")
    scored = aligned(others, overrides).join(order, "session_id")
    return scored.orderBy(F.desc("similarity"), "session_ord").limit(top_n).select("session_id", "cost", "match_rate", "similarity")
