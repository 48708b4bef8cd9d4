"""Evaluation of a ranking log: lines are cut into cases, each with its ranked candidates and its injected truth, and every case
stays in the result whatever is wrong with it.

In a log a case's list of candidates comes before its header and its truth after it. Only the lines that say something are
ordered, file by file: the number of headers before a line tells whose it is. Of several lists before a header the last
counts, of several truths after it the last.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import service_of
from .evalrank import evaluated

#: What the lines of a log look like.
_TIME = r"([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}(?::[0-9]{2})?)"
LIST_LINE = r"Soted Result List: (\[.*\])\s*$"
CASE_LINE = _TIME + r" Inject RCA (?:Pod )?Result:"
TRUTH_LINE = _TIME + r" Inject Ground Truth: (\S+), (\S+?)(?: score ([0-9]+))?\s*$"
#: Fields that a candidate must have.
NEEDED = ("score", "deepth", "pod")
#: What a case can lack, the first that holds is told; "ok" lacks nothing.
NO_LIST, UNREADABLE, DEFECT, NO_TRUTH, OK = "no list", "unreadable list", "candidate defect", "no truth", "ok"
CANDIDATES = "struct<problem:string,found:array<struct<pos:int,score:double,depth:bigint,pod:string,resource:string,events:string>>>"


def _candidates(text: str | None) -> tuple:
    if text is None:
        return NO_LIST, None
    try:
        listed = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return UNREADABLE, None
    found = []
    for pos, c in enumerate(listed, 1):
        if not isinstance(c, dict) or any(k not in c for k in NEEDED):
            return DEFECT, None
        try:
            told = [None if c.get(k) is None else str(c[k]) for k in ("resource", "events")]
            found.append((pos, float(c["score"]), int(c["deepth"]), str(c["pod"]), *told))
        except (TypeError, ValueError):
            return DEFECT, None
    return None, found


def _read_lists(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        rows = [_candidates(x) for x in part]
        yield pd.DataFrame({"problem": [p for p, _ in rows], "found": [f for _, f in rows]})


def log_cases(lines: DataFrame) -> DataFrame:
    """(path, case, query_time, inject_time, inject_pod, inject_type, claimed_rank, problem, candidates) of the log lines (value,
    _ord), as sources.jsonl.read_lines gives them. problem: why there are no candidates."""
    at = {"list": F.col("value").rlike(LIST_LINE), "case": F.col("value").rlike(CASE_LINE), "truth": F.col("value").rlike(TRUTH_LINE)}
    kind = F.when(at["list"], "list").when(at["case"], "case").when(at["truth"], "truth")
    said = lines.select(F.col("_ord.path").alias("path"), "_ord", "value", kind.alias("kind")).filter("kind is not null")
    before = Window.partitionBy("path").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    headers = F.coalesce(F.sum((F.col("kind") == "case").cast("bigint")).over(before), F.lit(0))
    dealt = said.withColumn("case", headers - (F.col("kind") == "truth").cast("bigint")).filter(F.col("case") >= 0)

    def part(line: str, group: int) -> Column:
        return F.regexp_extract("value", line, group)

    claims = part(TRUTH_LINE, 4) != ""

    def last(condition: Column, value: Column) -> Column:
        return F.max_by(F.when(condition, value), F.when(condition, F.col("_ord")))

    truth = (F.col("kind") == "truth") & ~claims
    grouped = dealt.groupBy("path", "case").agg(
        F.count_if(F.col("kind") == "case").alias("headers"), last(F.col("kind") == "case", part(CASE_LINE, 1)).alias("query_time"),
        last(F.col("kind") == "list", part(LIST_LINE, 1)).alias("list"), *(last(truth, part(TRUTH_LINE, k)).alias(c) for k, c in ((1, "inject_time"), (2, "inject_pod"), (3, "inject_type"))),
        last((F.col("kind") == "truth") & claims, part(TRUTH_LINE, 4)).cast("int").alias("claimed_rank"),
    )
    read = grouped.filter("headers > 0").withColumn("r", F.pandas_udf(_read_lists, CANDIDATES)("list"))
    return read.select("path", "case", "query_time", "inject_time", "inject_pod", "inject_type", "claimed_rank", F.col("r.problem").alias("problem"), F.col("r.found").alias("candidates"))


def evaluated_log(cases: DataFrame, truths: DataFrame, templates: DataFrame) -> DataFrame:
    """(path, case, query_time, claimed_rank, status, n_candidates and the ranks of evalrank.evaluated) of every case; what has no
    rank counts as not localized.

    truths: (inject_pod, inject_type, parts), what is right for an injection; templates: (id, template), the texts of the
    two numbers in a candidate's events.
    """
    known = cases.join(truths.select("inject_pod", "inject_type", "parts"), ["inject_pod", "inject_type"], "left")
    status = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("parts").isNull(), NO_TRUTH).otherwise(OK)
    known = known.withColumn("status", status).withColumn("case_id", F.concat_ws("#", "path", "case"))
    each = known.filter(F.col("status") == OK).select("case_id", "inject_pod", "parts", F.explode("candidates").alias("c")).select("case_id", "inject_pod", "parts", "c.*")
    numbers = F.split("events", "_")
    for k, name in enumerate(("src_text", "dst_text")):
        told = templates.select(F.col("id").cast("string").alias("_id"), F.col("template").alias(name))
        each = each.withColumn("_id", F.when(F.size(numbers) == 2, F.get(numbers, F.lit(k)))).join(told, "_id", "left").drop("_id").withColumn(name, F.coalesce(name, F.lit("")))
    lists = each.withColumn("service", service_of(F.col("pod"))).withColumn("inject_service", service_of(F.col("inject_pod")))
    ranks = evaluated(lists).drop("n_candidates")
    sizes = F.size("candidates").cast("bigint")
    return known.select("path", "case", "case_id", "query_time", "claimed_rank", "status", F.when(F.col("candidates").isNotNull(), sizes).alias("n_candidates")).join(ranks, "case_id", "left").drop("case_id")
