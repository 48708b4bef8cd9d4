"""Transition graphs of scenarios as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import HeuristicsConfig
from ..sources.scratch import staged

#: Nodes, and edges, of a graph that is drawn or walked on the driver; more raise.
MOST_DRAWN = 200_000


def in_scenario() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("action_idx")


def label(screen: str = "screen", command: str = "command_id", args: str = "abstract_args") -> Column:
    """One text for an action, equal for equal actions only: its three parts between bars, in which a bar is %7C, a
    percent sign %25 and null %0."""

    def part(c: str) -> Column:
        escaped = F.replace(F.replace(F.col(c), F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))
        return F.coalesce(escaped, F.lit("%0"))

    return F.concat(part(screen), F.lit("|"), part(command), F.lit("|"), part(args))


def parts_of(action: str) -> list[str]:
    """Screen, command and arguments of an action's text; null is empty."""
    return [{"%0": ""}.get(x, x.replace("%7C", "|").replace("%25", "%")) for x in action.split("|")]


def labelled(actions: DataFrame) -> DataFrame:
    """(session_id, action_idx, _ord, command_id, action): the action as one text key, which joins and hashes well."""
    return actions.select("session_id", "action_idx", "_ord", "command_id", label().alias("action"))


def nodes(acts: DataFrame) -> DataFrame:
    """(action, command_id, visit_count, first_seen), first_seen being the place of the first visit."""
    return acts.groupBy("action", "command_id").agg(F.count("*").alias("visit_count"), F.min("_ord").alias("first_seen"))


def pairs(acts: DataFrame) -> DataFrame:
    """(session_id, action_idx, _ord, src, dst): neighbours within a scenario."""
    return acts.select("session_id", "action_idx", "_ord", F.col("action").alias("src"), F.lead("action").over(in_scenario()).alias("dst")).filter("dst is not null")


def edges(acts: DataFrame) -> DataFrame:
    """(src, dst, frequency, failure_count, anomaly_score). The reverse edge's frequency is found by a join on the pair."""
    counted = pairs(acts).groupBy("src", "dst").agg(F.count("*").alias("frequency"))
    back = counted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("frequency").alias("backward"))
    f, b = F.col("frequency"), F.coalesce("backward", F.lit(0))
    score = F.when(F.col("src") == F.col("dst"), 1 - f / (f + 1)).otherwise((1 - (f - b) / (f + b + 1)) / 2)
    return counted.join(back, ["src", "dst"], "left").select("src", "dst", "frequency", F.lit(0).cast("bigint").alias("failure_count"), score.alias("anomaly_score"))


def heuristics(edge_table: DataFrame, config: HeuristicsConfig = HeuristicsConfig()) -> DataFrame:
    """Edges that are frequent and directed enough; nodes all stay."""
    return edge_table.filter((F.col("frequency") >= config.min_frequency) & (F.col("anomaly_score") <= (1 - config.dependency_threshold) / 2))


def anomalies(edge_table: DataFrame, threshold: float) -> DataFrame:
    return edge_table.filter(F.col("anomaly_score") > threshold)


def dead_commands(node_table: DataFrame, floor: float) -> DataFrame:
    """(command_id, visits): commands below the floor's share of all visits, summed over screens."""
    summed = node_table.groupBy("command_id").agg(F.sum("visit_count").alias("visits"))
    total = node_table.agg(F.sum("visit_count")).scalar()
    return summed.filter(F.col("visits") < total * F.lit(floor))


def p80_frequency(edge_table: DataFrame) -> DataFrame:
    """One row: the frequency at place min(floor(0.8 n), n - 1) of the sorted ones, 1 without edges.

    Counted by distinct frequency, so that what is ordered is small however many edges there are.
    """
    counted = edge_table.groupBy("frequency").agg(F.count("*").alias("n"))
    total = F.coalesce(counted.agg(F.sum("n")).scalar(), F.lit(0))
    upto = counted.alias("a").select("frequency", F.sum("n").over(Window.orderBy("frequency")).alias("upto"))
    place = F.least(F.floor(total * 0.8), total - 1)
    return upto.filter(F.col("upto") > place).agg(F.coalesce(F.min("frequency"), F.lit(1)).alias("p80"))


def edge_flags(edge_table: DataFrame) -> DataFrame:
    """Edges with is_frequent: the frequency reaches the eightieth percentile's pick."""
    return edge_table.withColumn("is_frequent", F.col("frequency") >= p80_frequency(edge_table).scalar())


def counted_steps(acts: DataFrame) -> DataFrame:
    """(src, dst, frequency, first_seen): how often dst follows src, and the place of the first time; dst is null for the
    ends of scenarios, so that the rows of a src make up all its visits. One window and one aggregate for nodes and edges."""
    steps = acts.select(F.col("action").alias("src"), F.lead("action").over(in_scenario()).alias("dst"), "_ord")
    return steps.groupBy("src", "dst").agg(F.count("*").alias("frequency"), F.min("_ord").alias("first_seen"))


def path_of_steps(rows: list) -> list[str]:
    """most_frequent_path of collected counted_steps."""
    seen, visits = {}, {}
    for r in rows:
        seen[r["src"]] = min(seen.get(r["src"], r["first_seen"]), r["first_seen"])
        visits[r["src"]] = visits.get(r["src"], 0) + r["frequency"]
    node_rows = [{"action": a, "visit_count": visits[a], "first_seen": seen[a]} for a in seen]
    return most_frequent_path(node_rows, [r for r in rows if r["dst"] is not None])


def most_frequent_path(node_rows: list, edge_rows: list) -> list[str]:
    """Greedy path over a collected graph: from the most visited root (or node) along the most frequent edge not used yet.

    Ties go to the node that was seen first. Graphs are small: distinct actions, whatever the number of events.
    """
    if not node_rows:
        return []
    seen = {r["action"]: r["first_seen"] for r in node_rows}
    out: dict[str, list] = {}
    for r in edge_rows:
        out.setdefault(r["src"], []).append((-r["frequency"], seen[r["dst"]], r["dst"]))
    entered = {r["dst"] for r in edge_rows}
    roots = [r for r in node_rows if r["action"] not in entered] or node_rows
    at = min(roots, key=lambda r: (-r["visit_count"], r["first_seen"]))["action"]
    path, used = [at], set()
    while len(path) <= len(node_rows) + 1:
        ways = [w for w in out.get(at, []) if (at, w[2]) not in used]
        if not ways:
            break
        to = min(ways)[2]
        used.add((at, to))
        path.append(to)
        at = to
    return path


def to_mermaid(node_rows: list, edge_rows: list, p80: int) -> str:
    ids = _numbered(node_rows)
    lines = ["flowchart TD", *(f'    N{ids[r["action"]]}["{_quoted(r["action"])}"]' for r in sorted(node_rows, key=lambda r: r["first_seen"]))]
    for r in _ordered(edge_rows, ids):
        note = f'|freq={r["frequency"]}|' if r["frequency"] >= p80 else ""
        lines.append(f'    N{ids[r["src"]]} -->{note} N{ids[r["dst"]]}')
    return "\n".join(lines) + "\n"


def to_dot(node_rows: list, edge_rows: list) -> str:
    ids = _numbered(node_rows)
    lines = ["digraph actions {", *(f'    N{ids[r["action"]]} [label="{_quoted(r["action"])}"];' for r in sorted(node_rows, key=lambda r: r["first_seen"]))]
    lines += [f'    N{ids[r["src"]]} -> N{ids[r["dst"]]} [label="freq={r["frequency"]}"];' for r in _ordered(edge_rows, ids)]
    return "\n".join([*lines, "}"]) + "\n"


def _numbered(node_rows: list) -> dict[str, int]:
    return {r["action"]: i for i, r in enumerate(sorted(node_rows, key=lambda r: r["first_seen"]))}


def _ordered(edge_rows: list, ids: dict[str, int]) -> list:
    return sorted(edge_rows, key=lambda r: (ids[r["src"]], ids[r["dst"]]))


def _quoted(s: str) -> str:
    return "|".join(parts_of(s)).replace("\\", "\\\\").replace('"', "'")


def error_actions(acts: DataFrame, events: DataFrame) -> DataFrame:
    """(action, errors): the actions that were the last before an exception of their session, and how many."""
    thrown = events.filter("kind = 'ExceptionThrown'").select("session_id", "_ord", F.lit(None).cast("string").alias("action"))
    both = acts.select("session_id", "_ord", "action").unionByName(thrown)
    before = Window.partitionBy("session_id").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("last", F.last("action", ignorenulls=True).over(before)).filter("action is null and last is not null")
    return told.groupBy(F.col("last").alias("action")).agg(F.count("*").alias("errors"))


def error_prone(edge_table: DataFrame, seeds: DataFrame, decay: float = 0.5, least: float = 0.05) -> DataFrame:
    """(action, distance, weight): actions from which an action with errors is reached along edges; weight is decay to the power
    of the fewest steps, and search ends where it falls under ``least``.

    Breadth first against the edges: each round joins the frontier with the edges into it, takes out what is known, and is
    staged; rounds end when nothing is new. seeds: (action).
    """
    into = staged(edge_table.select("src", "dst").filter("src <> dst").distinct(), "edges-back")
    front = staged(seeds.select("action").distinct(), "error-front")
    seen, distance, weight = front.withColumn("distance", F.lit(0)), 0, 1.0
    while weight * decay >= least and front.head(1):
        distance, weight = distance + 1, weight * decay
        near = into.join(front.select(F.col("action").alias("dst")), "dst").select(F.col("src").alias("action")).distinct()
        front = staged(near.join(seen.select("action"), "action", "left_anti"), "error-front")
        seen = seen.unionByName(front.withColumn("distance", F.lit(distance)))
    return seen.withColumn("weight", F.pow(F.lit(decay), F.col("distance")))


def subgraph(edge_table: DataFrame, actions: DataFrame) -> DataFrame:
    """The edges between actions that are both in actions (action)."""
    kept = actions.select("action").distinct()
    out = edge_table.join(kept.withColumnRenamed("action", "src"), "src", "left_semi")
    return out.join(kept.withColumnRenamed("action", "dst"), "dst", "left_semi")
