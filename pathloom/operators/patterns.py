"""Frequent subsequences of scenarios and the workflow report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ReportConfig
from ..sources.scratch import staged
from .graph import dead_commands, nodes, parts_of


def sequences(acts: DataFrame) -> DataFrame:
    """(session_id, actions) in order."""
    listed = acts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("action_idx", "action"))).alias("s"))
    return listed.select("session_id", F.transform("s", lambda x: x["action"]).alias("actions"))


def contains_pattern(actions: str = "actions", pattern: str = "pattern"):
    """Whether actions holds pattern as a subsequence: the place in the pattern moves on at each match."""
    return F.expr(f"aggregate({actions}, 0, (i, a) -> if(i < size({pattern}) and a = {pattern}[i], i + 1, i)) = size({pattern})")


def frequent_patterns(acts: DataFrame, min_support: int, max_length: int | None = None) -> DataFrame:
    """(pattern array<string>, support): action sequences, with gaps, that at least min_support scenarios contain.

    Patterns grow by an action a round: each is known in a session by the earliest place where it ends, from which a join
    with the session's later actions, of those that are frequent themselves, makes the longer ones. Rounds are staged and
    end when no pattern is frequent, so that nothing but their number is on the driver.
    """
    spark = acts.sparkSession
    if min_support < 1:
        return spark.createDataFrame([], "pattern array<string>, support bigint")
    base = staged(acts.select("session_id", "action_idx", "action"), "actions")
    grown, found = base.select("session_id", F.col("action_idx").alias("at"), F.array("action").alias("pattern")), []
    while max_length is None or len(found) < max_length:
        ends = staged(grown.groupBy("session_id", "pattern").agg(F.min("at").alias("at")), "pattern-ends")
        support = staged(ends.groupBy("pattern").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support), "patterns")
        if not support.head(1):
            break
        live = ends.join(support.select("pattern"), "pattern", "left_semi")
        if not found:
            base = base.join(support.select(F.col("pattern")[0].alias("action")), "action", "left_semi")
        found.append(support)
        longer = live.join(base, "session_id").filter("action_idx > at")
        grown = longer.select("session_id", F.col("action_idx").alias("at"), F.concat("pattern", F.array("action")).alias("pattern"))
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "pattern array<string>, support bigint"))


def short_patterns(acts: DataFrame, min_support: int, max_length: int = 3) -> DataFrame:
    """The same for patterns of a few actions in one plan, without staged rounds."""
    base = acts.select("session_id", "action_idx", "action")
    grown, out = base.select("session_id", F.col("action_idx").alias("at"), F.array("action").alias("pattern")), []
    for length in range(1, max_length + 1):
        support = grown.select("session_id", "pattern").distinct().groupBy("pattern").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
        out.append(support)
        if length < max_length:
            # Earliest end of each pattern in a session: later ends reach nothing more.
            ends = grown.join(support.select("pattern"), "pattern", "left_semi").groupBy("session_id", "pattern").agg(F.min("at").alias("at"))
            grown = ends.join(base, "session_id").filter("action_idx > at").select("session_id", F.col("action_idx").alias("at"), F.concat("pattern", F.array("action")).alias("pattern"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


PATTERN = "pattern array<string>, support bigint"


def _ends(grown: DataFrame, *more: str) -> DataFrame:
    """The earliest end of each pattern in each session, which is where all its longer patterns go on. Staged."""
    return staged(grown.groupBy("session_id", *more, "pattern").agg(F.min("at").alias("at")), "pattern-ends")


def _grown(ends: DataFrame, base: DataFrame, *more: str) -> DataFrame:
    """Each pattern made longer by one later action of its session."""
    longer = ends.join(base.select("session_id", "action_idx", "action"), "session_id").filter("action_idx > at")
    return longer.select("session_id", *more, F.col("action_idx").alias("at"), F.concat("pattern", F.array("action")).alias("pattern"))


def top_workflows(acts: DataFrame, n: int, min_support: int = 1, max_length: int | None = None) -> DataFrame:
    """(pattern, support) of the n patterns, of any length, with the greatest support; then the shorter, then by text.

    A longer pattern has no more support than what it goes on from and comes after it in a tie, so only patterns above the
    n-th support found so far grow, by actions above it. These are fewer than n in every round, whatever the sessions hold;
    rounds end when there are none. Only they reach the driver.
    """
    spark = acts.sparkSession
    base = staged(acts.select("session_id", "action_idx", "action"), "actions")
    grown = base.select("session_id", F.col("action_idx").alias("at"), F.array("action").alias("pattern"))
    best: list[tuple[int, int, list[str]]] = []
    actions: dict[str, int] = {}
    length, floor = 1, max(min_support, 1) - 1
    while n > 0:
        ends = _ends(grown)
        counted = ends.groupBy("pattern").agg(F.count("*").alias("support")).filter(F.col("support") > floor)
        fresh = [(-r["support"], length, r["pattern"]) for r in counted.orderBy(F.desc("support"), "pattern").limit(n).collect()]
        best = sorted([*best, *fresh])[:n]
        if len(best) == n:
            floor = max(floor, -best[-1][0])
        live = [p for support, _, p in fresh if -support > floor]
        if not live or length == max_length:
            break
        actions = actions or {p[0]: -support for support, _, p in fresh}
        told = F.broadcast(spark.createDataFrame([(p,) for p in live], "pattern array<string>"))
        named = [(a,) for a, support in actions.items() if support > floor]
        able = base.join(F.broadcast(spark.createDataFrame(named, "action string")), "action", "left_semi")
        grown = _grown(ends.join(told, "pattern", "left_semi"), able)
        length += 1
    found = spark.createDataFrame([(p, -support) for support, _, p in best], PATTERN)
    return found.orderBy(F.desc("support"), F.size("pattern"), "pattern")


def rare_failing(acts: DataFrame, failing: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    """(pattern, support, fraction, error_rate) of rare patterns that sessions with an error hold often enough; the first
    config.rare_n of them by error rate, length and text, or all if that is None.

    Patterns grow an action a round, from those that some failing session holds. With rare_n:

    * rounds end once so many patterns are known whose every session fails: what comes later is longer, and no better;
    * patterns that hold in the same sessions and end at the same places there go on alike, so that of these only the
      first rare_n by text grow. Sessions that repeat each other therefore do not double the patterns at each action.
    """
    spark, n = acts.sparkSession, config.rare_n
    bad = failing.select("session_id").distinct().withColumn("failing", F.lit(True))
    base = acts.select("session_id", "action_idx", "action").join(bad, "session_id", "left")
    base = staged(base.withColumn("failing", F.coalesce("failing", F.lit(False))), "actions")
    total = base.select("session_id").distinct().count()
    base = base.join(base.filter("failing").select("action").distinct(), "action", "left_semi")
    grown = base.select("session_id", "failing", F.col("action_idx").alias("at"), F.array("action").alias("pattern"))
    best: list[tuple] = []
    whole: list[DataFrame] = []
    length = 1
    place = F.xxhash64("session_id", "at")
    while n is None or n > 0:
        ends = _ends(grown, "failing")
        counted = ends.groupBy("pattern").agg(
            F.count("*").alias("support"), F.count_if("failing").alias("failed"),
            F.sum(place.cast("decimal(38,0)")).alias("ends_sum"), F.bit_xor(F.xxhash64("at", "session_id")).alias("ends_xor"),
        )
        counted = staged(counted.filter((F.col("failed") > 0) & (F.col("support") >= config.min_support)), "patterns")
        rated = counted.select("pattern", "support", (F.col("support") / F.lit(total)).alias("fraction"), (F.col("failed") / F.col("support")).alias("error_rate"))
        rated = rated.filter((F.col("fraction") <= config.rare_support) & (F.col("error_rate") >= config.error_rate))
        if n is None:
            whole.append(rated)
        else:
            fresh = rated.orderBy(F.desc("error_rate"), "pattern").limit(n).collect()
            best = sorted([*best, *((-r["error_rate"], length, r["pattern"], r["support"], r["fraction"]) for r in fresh)])[:n]
            if len(best) == n and best[-1][0] == -1.0:
                break
        if length == config.max_length or not counted.head(1):
            break
        live = counted
        if n is not None:
            alike = Window.partitionBy("ends_sum", "ends_xor").orderBy("pattern")
            live = counted.withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= n)
        grown = _grown(ends.join(live.select("pattern"), "pattern", "left_semi"), base, "failing")
        length += 1
    kind = "pattern array<string>, support bigint, fraction double, error_rate double"
    listed = spark.createDataFrame([(p, support, fraction, -rate) for rate, _, p, support, fraction in best], kind)
    return reduce(DataFrame.unionByName, whole, listed).orderBy(F.desc("error_rate"), F.size("pattern"), "pattern")


def workflow_report(acts: DataFrame, failing: DataFrame, config: ReportConfig = ReportConfig()) -> dict[str, DataFrame]:
    """The report's three tables; with the defaults patterns of any length and support count."""
    acts = staged(acts, "acts")
    return {
        "top_workflows": top_workflows(acts, config.top_n, config.min_support, config.max_length),
        "rare_failing": rare_failing(acts, failing, config),
        "dead_features": dead_commands(nodes(acts), config.dead_floor).orderBy("visits", "command_id"),
    }


def render_report(report: dict[str, DataFrame], total_visits: int) -> str:
    """The report as text; an action is written as screen:command."""

    def name(action: str) -> str:
        return ":".join(parts_of(action)[:2])

    def listed(title: str, lines: list[str]) -> list[str]:
        return [f"=== {title} ===", *(lines or ["  (none)"])]

    top = [f"  {i}. [{' → '.join(map(name, r['pattern']))}] (freq={r['support']})" for i, r in enumerate(report["top_workflows"].collect(), 1)]
    rare = [f"  [{' → '.join(map(name, r['pattern']))}] freq={r['support']} ({100 * r['fraction']:.1f}%) error_rate={100 * r['error_rate']:.1f}%" for r in report["rare_failing"].collect()]
    dead = [f"  {r['command_id']} freq={r['visits']} ({100 * r['visits'] / total_visits:.2f}%)" for r in report["dead_features"].collect()]
    return "\n".join([*listed("Top workflows", top), "", *listed("Rare failing workflows", rare), "", *listed("Dead features", dead)]) + "\n"
