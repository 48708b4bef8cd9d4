"""Invariant rules: each turns events into violations; the engine adds the sessions that pass.

A violation is (session_id, rule, severity, message, evidence): evidence lists sequence numbers. Rules are windows over a
session in source order; none of them leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import ClassVar, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ms_between
from ..sources.scratch import staged
from .fold import in_session

SEVERITIES = ("Warning", "Error", "Critical")


class Rule(Protocol):
    name: str

    def violations(self, events: DataFrame) -> DataFrame: ...


def _violations(found: DataFrame, rule: str, severity: str, message: Column, evidence: Column) -> DataFrame:
    return found.select("session_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"), evidence.cast("array<bigint>").alias("evidence"))


def _next(column: str) -> Column:
    return F.lead(column).over(in_session())


def _in_reach(earlier: Column, later: Column, window_ms: int | None) -> Column:
    """Whether a window of that width which ends at the later time (in ms) holds the earlier one; None: any."""
    return F.lit(True) if window_ms is None else (later - earlier).between(0, window_ms)


def _ms() -> Column:
    return F.unix_millis("ts")


@dataclass(frozen=True)
class NoUnhandledException:
    name: str = "NoUnhandledException"

    def violations(self, events: DataFrame) -> DataFrame:
        found = events.filter("kind = 'ExceptionThrown'")
        return _violations(found, self.name, "Critical", F.concat(F.lit("Unhandled exception: "), "exception_type", F.lit(": "), "message"), F.array("seq"))


@dataclass(frozen=True)
class NoErrorModalAfterCommand:
    """The event right after a command opens a screen that is named an error or a modal."""

    name: str = "NoErrorModalAfterCommand"
    severity: ClassVar[str] = "Error"

    def said(self, opened: Column, seq: Column, after: Column) -> tuple[Column, Column]:
        message = F.concat(F.lit("Error/Modal screen '"), opened, F.lit("' opened after command (seq "), seq.cast("string"), F.lit(")"))
        return message, F.concat(F.array(seq), after)

    def violations(self, events: DataFrame) -> DataFrame:
        return self.within(events)

    def within(self, events: DataFrame, window_ms: int | None = None) -> DataFrame:
        timed = events.withColumn("ms", _ms())
        pairs = timed.select("session_id", "kind", "seq", _next("kind").alias("next_kind"), _next("screen_id").alias("opened"), _next("seq").alias("next_seq"), _in_reach(F.col("ms"), _next("ms"), window_ms).alias("near"))
        found = pairs.filter((F.col("kind") == "CommandExecuted") & (F.col("next_kind") == "ScreenOpened") & (F.col("opened").contains("Error") | F.col("opened").contains("Modal")) & F.col("near"))
        return _violations(found, self.name, self.severity, *self.said(F.col("opened"), F.col("seq"), F.array("next_seq")))


@dataclass(frozen=True)
class CommandMustSucceed:
    commands: tuple[str, ...] = ()
    name: str = "CommandMustSucceed"

    def violations(self, events: DataFrame) -> DataFrame:
        found = events.filter((F.col("kind") == "CommandExecuted") & F.col("command_id").isin(list(self.commands)) & (F.col("outcome") != "success"))
        return _violations(found, self.name, "Error", F.concat(F.lit("Command '"), "command_id", F.lit("' did not succeed (seq "), F.col("seq").cast("string"), F.lit(")")), F.array("seq"))


@dataclass(frozen=True)
class ScreenMustNavigateForward:
    """A screen is opened or navigated to that the session has been on before."""

    name: str = "ScreenMustNavigateForward"
    severity: ClassVar[str] = "Warning"

    def said(self, shown: Column, seq: Column, none: Column | None = None) -> tuple[Column, Column]:
        return F.concat(F.lit("Navigation revisited screen '"), shown, F.lit("' (seq "), seq.cast("string"), F.lit(")")), F.array(seq)

    def violations(self, events: DataFrame) -> DataFrame:
        return self.within(events)

    def within(self, events: DataFrame, window_ms: int | None = None) -> DataFrame:
        shown = F.when(F.col("kind") == "ScreenOpened", F.col("screen_id")).when(F.col("kind") == "NavigationOccurred", F.col("nav_to"))
        visits = events.select("session_id", "seq", "_ord", _ms().alias("ms"), shown.alias("shown")).filter("shown is not null")
        of_screen = Window.partitionBy("session_id", "shown")
        reach = of_screen.orderBy("_ord") if window_ms is None else of_screen.orderBy("ms").rangeBetween(-window_ms, 0)
        found = visits.withColumn("earliest", F.min("_ord").over(reach)).filter(F.col("earliest") < F.col("_ord"))
        return _violations(found, self.name, self.severity, *self.said(F.col("shown"), F.col("seq")))


@dataclass(frozen=True)
class ValidationsPassBeforeSubmit:
    """A submitting command while validation failures since the last command or navigation are open."""

    suffixes: tuple[str, ...] = (".Submit", ".Save")
    name: str = "ValidationsPassBeforeSubmit"
    severity: ClassVar[str] = "Error"

    def said(self, command: Column, seq: Column, pending: Column) -> tuple[Column, Column]:
        message = F.concat(F.lit("Submit command '"), command, F.lit("' fired with "), F.size(pending).cast("string"), F.lit(" outstanding validation failure(s)"))
        return message, F.concat(pending, F.array(seq))

    def violations(self, events: DataFrame) -> DataFrame:
        return self.within(events)

    def within(self, events: DataFrame, window_ms: int | None = None) -> DataFrame:
        resets = F.col("kind").isin("CommandExecuted", "NavigationOccurred").cast("bigint")
        before = in_session().rowsBetween(Window.unboundedPreceding, -1)
        grouped = events.select("session_id", "_ord", _ms().alias("ms"), "seq", "kind", "command_id", F.coalesce(F.sum(resets).over(before), F.lit(0)).alias("stretch"))
        submits = reduce(lambda a, b: a | b, (F.col("command_id").endswith(s) for s in self.suffixes), F.lit(False))
        # A stretch ends with the command or navigation that resets it, so that its failures all come before.
        failure = F.when(F.col("kind") == "ValidationFailed", F.struct("_ord", "seq", "ms"))
        submit = F.max(F.when((F.col("kind") == "CommandExecuted") & submits, F.struct("command_id", "seq", "ms")))
        stretches = grouped.groupBy("session_id", "stretch").agg(F.array_sort(F.collect_list(failure)).alias("failures"), submit.alias("submit"))
        seen = F.filter("failures", lambda f: _in_reach(f["ms"], F.col("submit.ms"), window_ms))
        found = stretches.filter(F.col("submit").isNotNull()).select("session_id", "submit.command_id", "submit.seq", F.transform(seen, lambda f: f["seq"]).alias("pending")).filter(F.size("pending") > 0)
        return _violations(found, self.name, self.severity, *self.said(F.col("command_id"), F.col("seq"), F.col("pending")))


@dataclass(frozen=True)
class SuccessThenException:
    """A command reports success, and the next event is an exception whose type contains the pattern."""

    command: str
    pattern: str
    name: str = "SuccessThenException"
    note: str = ""
    severity: ClassVar[str] = "Error"

    def said(self, thrown: Column, seq: Column, after: Column) -> tuple[Column, Column]:
        start = F.concat(F.lit(f"{self.command} succeeded (seq "), seq.cast("string"), F.lit(") but produced "), thrown)
        return F.concat(start, F.lit(" (seq "), after[0].cast("string"), F.lit(")" + self.note)), F.concat(F.array(seq), after)

    def violations(self, events: DataFrame) -> DataFrame:
        return self.within(events)

    def within(self, events: DataFrame, window_ms: int | None = None) -> DataFrame:
        timed = events.withColumn("ms", _ms())
        pairs = timed.select("session_id", "kind", "command_id", "outcome", "seq", _next("kind").alias("next_kind"), _next("exception_type").alias("thrown"), _next("seq").alias("next_seq"), _in_reach(F.col("ms"), _next("ms"), window_ms).alias("near"))
        good = (F.col("kind") == "CommandExecuted") & (F.col("command_id") == self.command) & (F.col("outcome") == "success")
        found = pairs.filter(good & (F.col("next_kind") == "ExceptionThrown") & F.col("thrown").contains(self.pattern) & F.col("near"))
        return _violations(found, self.name, self.severity, *self.said(F.col("thrown"), F.col("seq"), F.array("next_seq")))


def _union(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return reduce(DataFrame.unionByName, (r.violations(events) for r in rules))


@dataclass(frozen=True)
class AndRule:
    """All rules must hold; what they report is reported under their own names."""

    name: str
    rules: tuple[Rule, ...]

    def violations(self, events: DataFrame) -> DataFrame:
        return _union(events, self.rules) if self.rules else NoUnhandledException().violations(events.limit(0))


@dataclass(frozen=True)
class OrRule:
    """One rule that holds is enough; if none does, what all report is reported."""

    name: str
    rules: tuple[Rule, ...]

    def violations(self, events: DataFrame) -> DataFrame:
        if not self.rules:
            return NoUnhandledException().violations(events.limit(0))
        each = reduce(DataFrame.unionByName, (r.violations(events).withColumn("part", F.lit(i)) for i, r in enumerate(self.rules)))
        failed = each.groupBy("session_id").agg(F.countDistinct("part").alias("n")).filter(F.col("n") == len(self.rules))
        return each.join(failed, "session_id", "left_semi").drop("part")


@dataclass(frozen=True)
class WithinWindow:
    """The rule, over the events of the first window_ms of each session."""

    name: str
    rule: Rule
    window_ms: int

    def violations(self, events: DataFrame) -> DataFrame:
        first = F.first("ts").over(in_session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        age = ms_between(F.col("ts"), first)
        return self.rule.violations(events.withColumn("_age", age).filter(F.col("_age").between(0, self.window_ms)).drop("_age"))


@dataclass(frozen=True)
class Rolling:
    """The rule over a rolling window: at each event it sees the session's events of the last window_ms up to that one, by
    event time. What several windows show is told once, as the window of the event that completes it shows it.

    A rule that looks back (at the event before, an earlier visit, failures still open) has a pass of its own, in which
    what it looks at must lie within the window, so that no window is laid out by itself; rules of one event stay as they
    are, and what And and Or hold is scheduled each. Any other rule raises.
    """

    name: str
    rule: Rule
    window_ms: int

    def violations(self, events: DataFrame) -> DataFrame:
        rule = self.rule
        if isinstance(rule, (AndRule, OrRule)):
            return type(rule)(rule.name, tuple(Rolling(r.name, r, self.window_ms) for r in rule.rules)).violations(events)
        if isinstance(rule, (NoUnhandledException, CommandMustSucceed)):
            return rule.violations(events)
        if not hasattr(rule, "within"):
            raise ValueError(f"{rule.name} has no schedule by windows")
        return rule.within(events, self.window_ms)


@dataclass(frozen=True)
class Engine:
    rules: tuple[Rule, ...] = field(default_factory=lambda: BUILTIN)

    def violations(self, events: DataFrame) -> DataFrame:
        """All violations; rule is the engine's rule, inner_rule the one that reports."""
        return reduce(DataFrame.unionByName, (r.violations(events).withColumnRenamed("rule", "inner_rule").withColumn("rule", F.lit(r.name)) for r in self.rules))

    def results(self, events: DataFrame) -> DataFrame:
        """(session_id, rule, passed, n_violations, max_severity) for every session and rule.

        The grid of sessions and rules is a generator of the few rule names on each session.
        """
        names = F.array(*(F.lit(r.name) for r in self.rules))
        grid = events.select("session_id").distinct().select("session_id", F.explode(names).alias("rule"))
        rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
        counted = self.violations(events).groupBy("session_id", "rule").agg(F.count("*").alias("n_violations"), F.max(rank).alias("severity_rank"))
        return grid.join(counted, ["session_id", "rule"], "left").select("session_id", "rule", F.col("n_violations").isNull().alias("passed"), F.coalesce("n_violations", F.lit(0)).alias("n_violations"), F.get(F.array(*map(F.lit, SEVERITIES)), F.col("severity_rank").cast("int") - 1).alias("max_severity"))

    def sessions(self, events: DataFrame) -> DataFrame:
        """(session_id, all_passed, max_severity)."""
        rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("max_severity")).cast("int")
        return self.results(events).groupBy("session_id").agg(F.bool_and("passed").alias("all_passed"), F.max(rank).alias("r")).select("session_id", "all_passed", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("r") - 1).alias("max_severity"))


BUILTIN: tuple[Rule, ...] = (NoUnhandledException(), NoErrorModalAfterCommand(), CommandMustSucceed(), ScreenMustNavigateForward(), ValidationsPassBeforeSubmit())

#: The example rule of diagnostic bundles.
DEMO = SuccessThenException("Graph47.Recalculate", "Negative", "Graph47.ResultMustBeNonNegative", " — off-by-one in quantity truncation when total > 1 000")


def exit_code(results: DataFrame) -> int:
    """2 with a critical violation, 1 with another, 0 without."""
    row = results.agg(F.bool_or(F.col("max_severity") == "Critical").alias("critical"), F.bool_and("passed").alias("passed")).head()
    return 2 if row["critical"] else 0 if row["passed"] in (True, None) else 1


def reported(engine: Engine, events: DataFrame) -> DataFrame:
    """(session_ord, session_id, position, rule, found): what each rule found in each session. Staged, so that the rules run
    once whatever is made of it."""
    names = F.array(*(F.lit(r.name) for r in engine.rules))
    sessions = events.groupBy("session_id").agg(F.min("_ord").alias("session_ord"))
    grid = sessions.select("session_ord", "session_id", F.posexplode(names).alias("position", "rule"))
    listed = F.array_sort(F.collect_list(F.struct("evidence", "severity", "message", F.col("inner_rule").alias("reported_by"))))
    found = engine.violations(events).groupBy("session_id", "rule").agg(listed.alias("found"))
    none = F.array().cast(found.schema["found"].dataType)
    return staged(grid.join(found, ["session_id", "rule"], "left").withColumn("found", F.coalesce("found", none)), "rule-report")


def _rows(report: DataFrame) -> Iterator:
    """In source and rule order, a partition at a time."""
    return report.orderBy("session_ord", "position").toLocalIterator()


def exit_code_of(report: DataFrame) -> int:
    """exit_code of what was reported."""
    worst = report.select(F.explode("found").alias("v")).agg(F.count("*").alias("n"), F.bool_or(F.col("v.severity") == "Critical").alias("critical")).head()
    return 2 if worst["critical"] else 1 if worst["n"] else 0


def text_lines(report: DataFrame) -> Iterator[str]:
    """A line for each session and rule, with the violations under it; rows come to the driver a partition at a time."""
    failed = report.groupBy("session_id").agg(F.bool_or(F.size("found") > 0).alias("failed"))
    told = failed.agg(F.count("*").alias("n"), F.count_if("failed").alias("failed")).head()
    yield f"sessions: {told['n']}  passed: {told['n'] - told['failed']}  failed: {told['failed']}"
    for r in _rows(report):
        yield f"  [{'FAIL' if r['found'] else 'PASS'}] session={r['session_id']} rule={r['rule']}"
        yield from (f"       {v['severity']}: {v['message']}" for v in r["found"])


def render_text(engine: Engine, events: DataFrame) -> str:
    return "\n".join(text_lines(reported(engine, events))) + "\n"


def json_lines(engine: Engine, events: DataFrame) -> DataFrame:
    """json_of of what the rules find."""
    return json_of(reported(engine, events))


def json_of(report: DataFrame) -> DataFrame:
    """(value): one JSON text for each session: its id, and its rules with what they found."""
    rules = F.array_sort(F.collect_list(F.struct("position", "rule", F.col("found").alias("violations"))))
    listed = report.groupBy("session_ord", "session_id").agg(rules.alias("results")).orderBy("session_ord")
    results = F.transform("results", lambda r: F.struct(r["rule"].alias("rule"), (F.size(r["violations"]) == 0).alias("passed"), r["violations"].alias("violations")))
    return listed.select(F.to_json(F.struct("session_id", results.alias("results"))).alias("value"))


def html_lines(report: DataFrame, title: str = "Rule report") -> Iterator[str]:
    """One table of sessions and rules; texts are escaped. Rows come to the driver a partition at a time."""
    import html

    name = html.escape(title)
    yield f"<!DOCTYPE html>\n<html lang=\"en\"><head><meta charset=\"utf-8\"><title>{name}</title></head><body>\n<h1>{name}</h1>"
    yield "<table><thead><tr><th>Session</th><th>Rule</th><th>Result</th><th>Violations</th></tr></thead><tbody>"
    for r in _rows(report):
        listed = [f"[{v['severity']}] {html.escape(v['message'])} (seq {', '.join(map(str, v['evidence']))})" for v in r["found"]]
        verdict = "FAIL" if listed else "PASS"
        cells = (html.escape(r["session_id"]), html.escape(r["rule"]))
        yield f"<tr><td>{cells[0]}</td><td>{cells[1]}</td><td class=\"{verdict.lower()}\">{verdict}</td><td>{'<br>'.join(listed)}</td></tr>"
    yield "</tbody></table></body></html>"


def render_html(engine: Engine, events: DataFrame, title: str = "Rule report") -> str:
    return "\n".join(html_lines(reported(engine, events), title)) + "\n"
