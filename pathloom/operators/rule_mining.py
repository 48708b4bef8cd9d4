"""Candidate rules mined from the corpus: which command answers, precedes or never follows which.

A session knows of each command where it comes first and last, and these two places decide all three constraints: b answers
every a if the last a is before the last b; a precedes every b if the first a is before the first b; b never follows a if
the first a is after the last b. So one aggregate by session and command, one list of them for each session, and one
aggregate by pair of commands count everything: rows are bounded by the distinct commands of a session, squared, before
they are summed, and by those of the corpus after.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import collected, staged

RESPONSE, PRECEDENCE, ABSENCE = "response", "precedence", "absence"
#: Mined rules that are taken into an engine.
MOST_RULES = 1000


def command_places(events: DataFrame) -> DataFrame:
    """(session_id, command, first, last): places of the first and the last time, as structs of the order and the seq."""
    at = F.struct("_ord", "seq")
    commands = events.filter("kind = 'CommandExecuted'")
    return commands.groupBy("session_id", F.col("command_id").alias("command")).agg(F.min(at).alias("first"), F.max(at).alias("last"))


def mine(events: DataFrame, min_sessions: int = 2, min_confidence: float = 0.95) -> DataFrame:
    """(rule, a, b, sessions, satisfied, confidence) of two different commands.

    sessions: those that the rule is about: with an a for a response, with a b for a precedence, with both for an absence.
    Commands of fewer than min_sessions sessions are left out before they are paired.
    """
    places = staged(command_places(events), "command-places")
    often = places.groupBy("command").agg(F.count("*").alias("sessions")).filter(F.col("sessions") >= min_sessions)
    kept = places.join(often.select("command"), "command", "left_semi")
    held = kept.groupBy("session_id").agg(F.collect_list(F.struct("command", F.col("first._ord").alias("first"), F.col("last._ord").alias("last"))).alias("c"))
    pairs = held.select("c", F.explode("c").alias("x")).select("x", F.explode("c").alias("y")).filter("x.command <> y.command")
    counted = pairs.groupBy(F.col("x.command").alias("a"), F.col("y.command").alias("b")).agg(
        F.count("*").alias("both"), F.count_if(F.expr("x.last < y.last")).alias("answered"), F.count_if(F.expr("x.first < y.first")).alias("preceded"), F.count_if(F.expr("x.first > y.last")).alias("absent")
    )
    sizes = often.withColumnRenamed("sessions", "n")
    counted = counted.join(sizes.withColumnsRenamed({"command": "a", "n": "of_a"}), "a").join(sizes.withColumnsRenamed({"command": "b", "n": "of_b"}), "b")
    told = F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.col(sessions).alias("sessions"), F.col(good).alias("satisfied"))
        for rule, sessions, good in ((RESPONSE, "of_a", "answered"), (PRECEDENCE, "of_b", "preceded"), (ABSENCE, "both", "absent"))
    ))
    rules = counted.select("a", "b", F.explode(told).alias("r")).select("r.rule", "a", "b", "r.sessions", "r.satisfied")
    return rules.withColumn("confidence", F.col("satisfied") / F.col("sessions")).filter((F.col("sessions") >= min_sessions) & (F.col("confidence") >= min_confidence))


@dataclass(frozen=True)
class MinedRule:
    """A mined constraint as a rule: its violations are the sessions that it is about and that do not keep it."""

    rule: str
    a: str
    b: str
    severity: ClassVar[str] = "Warning"

    @property
    def name(self) -> str:
        return {RESPONSE: f"{self.a} is answered by {self.b}", PRECEDENCE: f"{self.a} precedes {self.b}", ABSENCE: f"{self.b} never follows {self.a}"}[self.rule]

    def violations(self, events: DataFrame) -> DataFrame:
        two = command_places(events.filter(F.col("command_id").isin(self.a, self.b))).groupBy("session_id")
        held = two.agg(*(F.max(F.when(F.col("command") == c, F.struct("first", "last"))).alias(k) for k, c in (("a", self.a), ("b", self.b))))
        broken, evidence = {
            RESPONSE: (F.col("a").isNotNull() & ~F.coalesce(F.col("a.last._ord") < F.col("b.last._ord"), F.lit(False)), F.array("a.last.seq")),
            PRECEDENCE: (F.col("b").isNotNull() & ~F.coalesce(F.col("a.first._ord") < F.col("b.first._ord"), F.lit(False)), F.array("b.first.seq")),
            ABSENCE: (F.coalesce(F.col("a.first._ord") < F.col("b.last._ord"), F.lit(False)), F.array("a.first.seq", "b.last.seq")),
        }[self.rule]
        return held.filter(broken).select("session_id", F.lit(self.name).alias("rule"), F.lit(self.severity).alias("severity"), F.lit(f"Mined rule broken: {self.name}").alias("message"), evidence.cast("array<bigint>").alias("evidence"))


def as_rules(mined: DataFrame, most: int = MOST_RULES) -> tuple[MinedRule, ...]:
    """The mined rules for rules.Engine, in order of confidence; more than ``most`` raise."""
    rows = collected(mined.orderBy(F.desc("confidence"), F.desc("sessions"), "rule", "a", "b"), most, "mined rules")
    return tuple(MinedRule(r["rule"], r["a"], r["b"]) for r in rows)
