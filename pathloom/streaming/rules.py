"""Rules and summaries over a directory of growing event logs.

A session's source order is what counts: rules over several events wait for the watermark and then walk the session by
its sequence numbers, so that events may come in any order within the allowed lateness.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import NoErrorModalAfterCommand, ScreenMustNavigateForward, SuccessThenException, ValidationsPassBeforeSubmit
from ..sources.jsonl import parse_lines


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Good lines of the log files that come into a folder."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse_lines(lines).filter("error_class is null").drop("value", "raw", "error_class")


def unhandled_exceptions(events: DataFrame) -> DataFrame:
    """Needs no state: each exception is a violation."""
    return events.filter("kind = 'ExceptionThrown'").select("session_id", F.lit("NoUnhandledException").alias("rule"), F.lit("Critical").alias("severity"), F.concat(F.lit("Unhandled exception: "), "exception_type", F.lit(": "), "message").alias("message"), "seq", "ts")


def kind_counts(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, kind, n) by event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))


def session_segments(events: DataFrame, gap: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """(session_id, window, events): stretches of a session without a pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("events"))


class SessionWalk(StatefulProcessor):
    """Walks each session in source order, whatever order its events come in, and reports what the rules find.

    State of a session: the events that wait (list), since an earlier one may still come until the watermark has passed
    them; the step before (value: the last event, for rules that look at neighbours); the validation failures since the
    last command or navigation (list); the screens that it has shown (map); the time of its last event (value). A timer at
    each waiting event lets it go on; a timer keep_for after the last event drops the state. Of a session whose clock went
    back, an event waits for all that come before it by number.
    """

    STEP = "seq long, kind string, command_id string, outcome string, screen_id string, nav_to string, exception_type string, ms long"

    def __init__(self, rules: tuple, keep_ms: int):
        self.rules, self.keep_ms = rules, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.STEP)
        self.before = handle.getValueState("before", self.STEP)
        self.pending = handle.getListState("pending", "seq long")
        self.shown = handle.getMapState("shown", "screen string", "visits long")
        self.latest = handle.getValueState("latest", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come, latest = [], self.latest.get()[0] if self.latest.exists() else 0
        for batch in rows:
            come += [tuple(None if pd.isna(x) else x for x in r) for r in batch[[c.split()[0] for c in self.STEP.split(", ")]].itertuples(index=False)]
        if come:
            self.waiting.appendList([(int(r[0]), *r[1:7], int(r[7])) for r in come])
            for ms in {int(r[7]) for r in come}:
                self.handle.registerTimer(max(ms, timerValues.getCurrentWatermarkInMs() + 1))
            newest = max(int(r[7]) for r in come)
            if newest > latest:
                self.latest.update((newest,))
                if latest:
                    self.handle.deleteTimer(latest + self.keep_ms)
                self.handle.registerTimer(max(newest + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, found = timerValues.getCurrentWatermarkInMs(), []
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = list(takewhile(lambda r: r[7] <= mark, waiting))
        if ready:
            self.waiting.clear()
            if waiting[len(ready) :]:
                self.waiting.put(waiting[len(ready) :])
            found = self._walked(ready)
        if not waiting[len(ready) :] and self.latest.exists() and self.latest.get()[0] + self.keep_ms <= mark:
            for state in (self.waiting, self.before, self.pending, self.shown, self.latest):
                state.clear()
        if found:
            yield pd.DataFrame([(key[0], *f) for f in found], columns=["session_id", "place", "text", "seq", "others"])

    def _walked(self, steps: list[tuple]) -> list[tuple]:
        """(place of the rule, text, seq, others) of what the rules find in further steps of the session."""
        before = tuple(self.before.get()) if self.before.exists() else None
        pending = [r[0] for r in self.pending.get()] if self.pending.exists() else []
        out, kept = [], list(pending)
        for step in steps:
            seq, kind, command, outcome, screen, nav_to, thrown, _ = step
            shown = {"ScreenOpened": screen, "NavigationOccurred": nav_to}.get(kind)
            visits = 0
            if shown is not None:
                visits = self.shown.getValue((shown,))[0] if self.shown.containsKey((shown,)) else 0
                self.shown.updateValue((shown,), (visits + 1,))
            for place, rule in enumerate(self.rules):
                if isinstance(rule, NoErrorModalAfterCommand):
                    if before and before[1] == "CommandExecuted" and kind == "ScreenOpened" and ("Error" in (screen or "") or "Modal" in (screen or "")):
                        out.append((place, screen, before[0], [seq]))
                elif isinstance(rule, SuccessThenException):
                    good = before and before[1:4] == ("CommandExecuted", rule.command, "success")
                    if good and kind == "ExceptionThrown" and rule.pattern in (thrown or ""):
                        out.append((place, thrown, before[0], [seq]))
                elif isinstance(rule, ScreenMustNavigateForward):
                    if visits:
                        out.append((place, shown, seq, []))
                elif isinstance(rule, ValidationsPassBeforeSubmit):
                    if kind == "CommandExecuted" and kept and (command or "").endswith(rule.suffixes):
                        out.append((place, command, seq, list(kept)))
            if kind in ("CommandExecuted", "NavigationOccurred"):
                kept = []
            elif kind == "ValidationFailed":
                kept.append(seq)
            before = step
        self.before.update(before)
        if kept != pending:
            self.pending.clear()
            if kept:
                self.pending.put([(s,) for s in kept])
        return out


def _walk(events: DataFrame, rules: tuple, late: str, keep_for: str) -> DataFrame:
    spark = events.sparkSession
    # List, map and value states with timers need this store.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keep_ms = int(pd.Timedelta(keep_for).total_seconds() * 1000)
    marked = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    steps = marked.select("session_id", "ts", *(c.split()[0] for c in SessionWalk.STEP.split(", ")))
    kind = "session_id string, place int, text string, seq bigint, others array<bigint>"
    return steps.groupBy("session_id").transformWithStateInPandas(SessionWalk(rules, keep_ms), kind, "Append", "EventTime")


#: Rules that need a session's order; the others look at one event and run on streams as they are.
ORDERED = (NoErrorModalAfterCommand, SuccessThenException, ScreenMustNavigateForward, ValidationsPassBeforeSubmit)


def session_violations(events: DataFrame, rules: tuple, late: str = "10 minutes", keep_for: str = "1 hour") -> DataFrame:
    """(session_id, rule, severity, message, evidence) of ORDERED rules on a stream: the rows that the rules give over all
    events at once, as soon as the watermark has passed them. ``late`` is how much later than others an event may come;
    keep_for how long a session's state stays after its last event."""
    if not rules or any(type(r) not in ORDERED for r in rules):
        raise ValueError("rules that need no order, or hold other rules, do not run here")
    found = _walk(events, rules, late, keep_for)
    parts = [(F.lit(r.name), F.lit(r.severity), *r.said(F.col("text"), F.col("seq"), F.col("others"))) for r in rules]

    def of(k: int):
        return reduce(lambda out, i: F.when(F.col("place") == i, parts[i][k]).otherwise(out), range(1, len(parts)), parts[0][k])

    return found.select("session_id", of(0).alias("rule"), of(1).alias("severity"), of(2).alias("message"), of(3).alias("evidence"))


def revisited_screens(events: DataFrame, late: str = "10 minutes", keep_for: str = "1 hour") -> DataFrame:
    """(session_id, seq, screen): screens that a session comes back to; the screens seen are the state."""
    return _walk(events, (ScreenMustNavigateForward(),), late, keep_for).select("session_id", "seq", F.col("text").alias("screen"))
