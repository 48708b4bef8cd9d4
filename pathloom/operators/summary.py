"""Corpus summaries, slices and the last-write-wins store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import index_columns, is_error, rounded_rate


def summary(events: DataFrame) -> DataFrame:
    """One row: sessions, events, errors, error_rate (three digits)."""
    return events.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("events"), F.count_if(is_error()).alias("errors")).withColumn("error_rate", rounded_rate(F.col("errors"), F.col("events")))


def per_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def error_sessions(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'ExceptionThrown'").select("session_id").distinct()


def session_ids(events: DataFrame) -> DataFrame:
    return events.select("session_id").distinct().orderBy("session_id")


def slice_by(events: DataFrame, dimension: str, value: str) -> DataFrame:
    """Events whose dimension (session, command, screen, outcome, entity) has the value, by session and sequence."""
    columns = index_columns() | {"idx_session": F.col("session_id"), "idx_entity": F.col("domain_entity_id")}
    column: Column = columns[{"session": "idx_session", "command": "idx_command_id", "screen": "idx_screen_id", "outcome": "idx_outcome", "entity": "idx_entity"}[dimension]]
    return events.filter(column == value).orderBy("session_id", "seq")


def last_write_wins(events: DataFrame) -> DataFrame:
    """Of the events with one session and sequence number the last in source order."""
    newest = Window.partitionBy("session_id", "seq").orderBy(F.col("_ord").desc())
    return events.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def dimensions(events: DataFrame) -> DataFrame:
    """(session_id, dims): distinct commands (executed ones only), opened screens and outcomes, each with its prefix."""
    parts = F.array(
        F.when(F.col("kind") == "CommandExecuted", F.concat(F.lit("cmd:"), "command_id")),
        F.when(F.col("kind") == "ScreenOpened", F.concat(F.lit("screen:"), "screen_id")),
        F.concat(F.lit("outcome:"), "outcome"),
    )
    return events.groupBy("session_id").agg(F.array_distinct(F.flatten(F.collect_set(F.array_compact(parts)))).alias("dims"))


def similar_sessions(events: DataFrame, probe: str, top_n: int) -> DataFrame:
    """(session_id, score): Jaccard similarity of dimension sets with the probe's, best first; ties by session.

    Candidates share an indexed dimension with the probe, where operations count as commands; so a score can be 0.
    """
    idx = index_columns()
    keyed = F.array_compact(F.array(F.concat(F.lit("cmd:"), idx["idx_command_id"]), F.concat(F.lit("screen:"), idx["idx_screen_id"]), F.concat(F.lit("outcome:"), idx["idx_outcome"])))
    keys = events.select("session_id", F.explode(keyed).alias("key")).distinct()
    mine = dimensions(events.filter(F.col("session_id") == probe)).select(F.col("dims").alias("probe_dims"))
    wanted = mine.select(F.explode("probe_dims").alias("key"))
    candidates = keys.join(wanted, "key", "left_semi").select("session_id").distinct().filter(F.col("session_id") != probe)
    scored = dimensions(events.join(candidates, "session_id", "left_semi")).withColumn("probe_dims", mine.scalar())
    both, either = F.size(F.array_intersect("dims", "probe_dims")), F.size(F.array_union("dims", "probe_dims"))
    return scored.select("session_id", F.when(either == 0, 1.0).otherwise(both / either).alias("score")).orderBy(F.desc("score"), "session_id").limit(top_n)
