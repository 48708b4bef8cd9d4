"""Folding of sessions into scenarios of canonical actions, with exact loss accounting.

All windows share one partitioning (session_id) and order (_ord, the source order), so that a plan sorts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import FoldConfig
from ..functions.abstraction import abstract_args
from ..functions.scalar import ms_between

UNKNOWN = "<unknown>"


def in_session() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("_ord")


def so_far() -> WindowSpec:
    return in_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_screen(events: DataFrame) -> DataFrame:
    """Adds screen: the last one opened or navigated to, in source order."""
    shown = F.when(F.col("kind") == "ScreenOpened", F.col("screen_id")).when(F.col("kind") == "NavigationOccurred", F.col("nav_to"))
    return events.withColumn("screen", F.coalesce(F.last(shown, ignorenulls=True).over(so_far()), F.lit(UNKNOWN)))


def with_pauses(events: DataFrame, config: FoldConfig) -> DataFrame:
    """Adds is_pause: more than the idle gap since the event before, of whatever kind."""
    gap = ms_between(F.col("ts"), F.lag("ts").over(in_session()))
    return events.withColumn("is_pause", F.coalesce(gap > config.idle_gap_ms, F.lit(False)))


def commands(events: DataFrame, config: FoldConfig, nested: bool = True) -> DataFrame:
    """Executed commands with the screen in effect, abstract_args and is_burst.

    A burst repeats the action of the command before it within the burst gap. Whether that one was collapsed itself does not
    matter (then it equals what it was collapsed into), so that one lag over the commands decides.
    """
    found = with_screen(with_pauses(events, config)).filter("kind = 'CommandExecuted'").withColumn("abstract_args", abstract_args(F.col("args"), config, nested))
    gap = ms_between(F.col("ts"), F.lag("ts").over(in_session()))
    same = F.lag(action()).over(in_session()) == action()
    return found.withColumn("is_burst", F.coalesce(same & (gap >= 0) & (gap < config.burst_gap_ms), F.lit(False)))


def action() -> Column:
    return F.struct(F.col("screen"), F.col("command_id"), F.col("abstract_args"))


def scenarios(events: DataFrame, config: FoldConfig, nested: bool = True) -> DataFrame:
    """(session_id, action_idx, screen, command_id, abstract_args, _ord, seq, ts): the actions that are kept."""
    kept = commands(events, config, nested).filter(~F.col("is_burst"))
    return kept.withColumn("action_idx", F.row_number().over(in_session()).cast("bigint") - 1).select("session_id", "action_idx", "screen", "command_id", "abstract_args", "_ord", "seq", "ts")


def fold_report(events: DataFrame, config: FoldConfig, nested: bool = True) -> DataFrame:
    """Per session: input_events = output_actions + bursts_collapsed + noise_dropped, and pauses."""
    whole = with_pauses(events, config).groupBy("session_id").agg(F.count("*").alias("input_events"), F.count_if(F.col("kind") != "CommandExecuted").alias("noise_dropped"), F.count_if("is_pause").alias("pauses"))
    bursts = commands(events, config, nested).groupBy("session_id").agg(F.count_if("is_burst").alias("bursts_collapsed"))
    both = whole.join(bursts, "session_id", "left").withColumn("bursts_collapsed", F.coalesce("bursts_collapsed", F.lit(0)))
    return both.select("session_id", "input_events", (F.col("input_events") - F.col("noise_dropped") - F.col("bursts_collapsed")).alias("output_actions"), "bursts_collapsed", "noise_dropped", "pauses")


def fold_totals(report: DataFrame) -> DataFrame:
    return report.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_events", "output_actions", "bursts_collapsed", "noise_dropped", "pauses")))


def refold(actions: DataFrame, config: FoldConfig, nested: bool = True) -> DataFrame:
    """Abstract again and collapse all neighbours that are equal; adds collapsed flags before dropping nothing."""
    again = actions.withColumn("abstract_args", abstract_args(F.col("abstract_args"), config, nested)) if nested else actions
    order = Window.partitionBy("session_id").orderBy("action_idx")
    return again.withColumn("collapsed", F.coalesce(F.lag(action()).over(order) == action(), F.lit(False)))


def refold_report(actions: DataFrame, config: FoldConfig, nested: bool = True) -> DataFrame:
    return refold(actions, config, nested).groupBy("session_id").agg(F.count("*").alias("input_actions"), F.count_if(~F.col("collapsed")).alias("output_actions"), F.count_if("collapsed").alias("duplicates_collapsed"))


def action_sources(events: DataFrame, config: FoldConfig, nested: bool = True) -> DataFrame:
    """(session_id, action_idx, action columns, seqs, first_seq): the events that went into each action."""
    runs = commands(events, config, nested).withColumn("action_idx", F.sum((~F.col("is_burst")).cast("bigint")).over(so_far()) - 1)
    grouped = runs.groupBy("session_id", "action_idx", "screen", "command_id", "abstract_args").agg(F.array_sort(F.collect_list(F.struct("_ord", "seq"))).alias("s"))
    return grouped.select("session_id", "action_idx", "screen", "command_id", "abstract_args", F.transform("s", lambda x: x["seq"]).alias("seqs"), F.col("s")[0]["seq"].alias("first_seq"))


def union_windows(windows: list[DataFrame]) -> DataFrame:
    """The events of several windows as one source, each with its window number, in the order of the windows."""
    numbered = (w.withColumn("window", F.lit(i)).withColumn("_ord", F.struct(F.lit(i).alias("window"), F.col("_ord").alias("at"))) for i, w in enumerate(windows))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def scenario_lines(events: DataFrame, config: FoldConfig, nested: bool = True) -> DataFrame:
    """One JSON text per session: its actions with their source sequence numbers, and its fold report."""
    sources = action_sources(events, config, nested)
    listed = sources.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("action_idx", "screen", "command_id", "abstract_args", "seqs"))).alias("actions"))
    report = fold_report(events, config, nested)
    return report.join(listed, "session_id", "left").select("session_id", F.to_json(F.struct("session_id", "actions", F.struct(*[c for c in report.columns if c != "session_id"]).alias("fold_report"))).alias("value"))


def keep_commands(events: DataFrame, prefixes: list[str]) -> DataFrame:
    """Events whose command begins with one of the prefixes, renumbered within their session."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.coalesce(F.col("command_id").startswith(p), F.lit(False))
    return _renumbered(events.filter(keep))


def drop_commands(events: DataFrame, prefixes: list[str]) -> DataFrame:
    """Events whose command begins with none of the prefixes, renumbered within their session; those without one stay."""
    drop = F.lit(False)
    for p in prefixes:
        drop = drop | F.coalesce(F.col("command_id").startswith(p), F.lit(False))
    return _renumbered(events.filter(~drop))


def _renumbered(events: DataFrame) -> DataFrame:
    return events.withColumn("seq", F.row_number().over(in_session()).cast("bigint") - 1)
