"""Process trees by recursive cuts of the directly-follows graph.

The log stays in Spark: scenarios are folded into variants (a distinct command sequence and its count), staged as a row for
each step. A level of the tree is one job: every command of a part that is still open carries the part's path, a window
within variant and path projects each variant to its parts, and one aggregate gives every part's directly-follows pairs,
first and last commands. Only those reach the driver, which cuts them: at most the square of the number of distinct
commands for all parts of a level together, and refused beyond InductiveConfig.max_edges.

A tree is a tuple: (kind, children or names).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import InductiveConfig
from ..sources.scratch import collected, staged

Tree = tuple


def variants(acts: DataFrame) -> DataFrame:
    """(commands array<string>, n): each distinct command sequence with its number of sessions."""
    ordered = acts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("action_idx", "command_id"))).alias("s"))
    return ordered.select(F.transform("s", lambda x: x["command_id"]).alias("commands")).groupBy("commands").agg(F.count("*").alias("n"))


def directly_follows(acts: DataFrame, activities: list[str] | None = None, min_count: int = 1) -> DataFrame:
    """(src, dst, n) of commands that follow each other once others than the activities are taken out."""
    from .graph import in_scenario

    kept = acts if activities is None else acts.filter(F.col("command_id").isin(activities))
    followed = kept.select(F.col("command_id").alias("src"), F.lead("command_id").over(in_scenario()).alias("dst")).filter("dst is not null")
    return followed.groupBy("src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def edge_activities(acts: DataFrame) -> DataFrame:
    """(session_id, first_command, last_command)."""
    return acts.groupBy("session_id").agg(F.min_by("command_id", "action_idx").alias("first_command"), F.max_by("command_id", "action_idx").alias("last_command"))


class Part(NamedTuple):
    """What a cut looks at: the commands of one part of the log, its pairs, and where its projected variants start and end."""

    names: frozenset[str]
    pairs: set[tuple[str, str]]
    starts: set[str]
    ends: set[str]


def steps(acts: DataFrame) -> DataFrame:
    """(variant, idx, command, n): the steps of the variants, each variant with its number of sessions. Staged."""
    numbered = staged(variants(acts).select(F.monotonically_increasing_id().alias("variant"), "commands", "n"), "variants")
    return staged(numbered.select("variant", "n", F.posexplode("commands").alias("idx", "command")), "variant-steps")


def level_parts(log: DataFrame, paths: dict[str, str], config: InductiveConfig) -> dict[str, Part]:
    """The parts, by path, of a level in which each command of an open part has that part's path: one job for all."""
    spark = log.sparkSession
    told = F.broadcast(spark.createDataFrame(sorted(paths.items()), "command string, path string"))
    projected = Window.partitionBy("variant", "path").orderBy("idx")
    around = log.join(told, "command").select(
        "path", "command", "n", F.lag("command").over(projected).isNull().alias("starts"), F.lead("command").over(projected).alias("follower")
    )
    counted = around.groupBy("path", "starts", "command", "follower").agg(F.sum("n").alias("n"))
    names: dict[str, set[str]] = {}
    for command, path in paths.items():
        names.setdefault(path, set()).add(command)
    follows: dict[str, dict[tuple[str, str], int]] = {path: {} for path in names}
    starts: dict[str, set[str]] = {path: set() for path in names}
    ends: dict[str, set[str]] = {path: set() for path in names}
    for r in collected(counted, config.max_edges, "pairs of commands that follow each other"):
        if r["starts"]:
            starts[r["path"]].add(r["command"])
        if r["follower"] is None:
            ends[r["path"]].add(r["command"])
        else:
            of, pair = follows[r["path"]], (r["command"], r["follower"])
            of[pair] = of.get(pair, 0) + r["n"]
    return {
        path: Part(frozenset(own), {pair for pair, n in follows[path].items() if n >= config.min_count}, starts[path], ends[path])
        for path, own in names.items()
    }


def cut(part: Part) -> tuple[str, list[frozenset[str]]]:
    """The kind of a part of several commands, and its children's commands; a flower has none."""
    if len(groups := _components(part.names, part.pairs)) > 1:
        return "choice", groups
    if order := _line(part.names, part.pairs):
        return "sequence", [frozenset([c]) for c in order]
    redo = frozenset(a for a, b in part.pairs if a in part.ends and b in part.starts)
    if redo and redo != part.names:
        return "loop", [part.names - redo, redo]
    return "flower", []


def discover(acts: DataFrame, config: InductiveConfig = InductiveConfig()) -> Tree:
    """The process tree of the scenarios; a log without commands is ("tau",). Every level of the tree is one job."""
    log = steps(acts)
    commands = [r["command"] for r in collected(log.select("command").distinct(), config.max_commands, "distinct commands")]
    if not commands:
        return ("tau",)
    if len(commands) == 1:
        return ("activity", commands[0])
    made: dict[str, tuple[str, list]] = {}
    paths = {c: "" for c in commands}
    while paths:
        below: dict[str, str] = {}
        for path, part in level_parts(log, paths, config).items():
            kind, children = cut(part)
            made[path] = (kind, children or sorted(part.names))
            for k, names in enumerate(children):
                if len(names) > 1:
                    below |= dict.fromkeys(names, f"{path}.{k}")
        paths = below

    def grown(path: str) -> Tree:
        kind, children = made[path]
        if kind == "flower":
            return ("flower", *children)
        return (kind, *(("activity", *names) if len(names) == 1 else grown(f"{path}.{k}") for k, names in enumerate(children)))

    return grown("")


def _components(names: frozenset[str], pairs: set[tuple[str, str]]) -> list[frozenset[str]]:
    """Parts that no pair joins, by their smallest member."""
    near = {c: set() for c in names}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    left, out = set(names), []
    while left:
        found, edge = set(), {min(left)}
        while edge:
            found |= edge
            edge = set().union(*(near[c] for c in edge)) - found
        left -= found
        out.append(frozenset(found))
    return out


def _line(names: frozenset[str], pairs: set[tuple[str, str]]) -> list[str] | None:
    """The names in order if each reaches all later and no earlier ones (itself does not count), else None."""
    reach = {}
    after = {c: set() for c in names}
    for a, b in pairs:
        after[a].add(b)
    for c in names:
        found, edge = set(), after[c]
        while edge:
            found |= edge
            edge = set().union(*(after[b] for b in edge)) - found
        reach[c] = found - {c}
    order = sorted(names, key=lambda c: (-len(reach[c]), c))
    return order if all(reach[c] == set(order[i + 1 :]) for i, c in enumerate(order)) else None


def display(tree: Tree) -> str:
    kind, *rest = tree
    if kind == "activity":
        return rest[0]
    if kind == "tau":
        return "τ"
    mark = {"sequence": "→", "choice": "×", "loop": "↺", "flower": "flower"}[kind]
    return f"{mark}({', '.join(rest if kind == 'flower' else map(display, rest))})"


def tree_edges(tree: Tree) -> set[tuple[str, str]]:
    """The transitions that the tree implies."""

    def ends(t: Tree, last: bool) -> set[str]:
        kind, *rest = t
        if kind in ("activity", "flower"):
            return set(rest)
        if kind == "sequence":
            return ends(rest[-1 if last else 0], last)
        return set().union(*(ends(c, last) for c in (rest[:1] if kind == "loop" else rest))) if rest else set()

    kind, *rest = tree
    if kind in ("activity", "tau"):
        return set()
    if kind == "flower":
        return {(a, b) for a in rest for b in rest}
    out = set().union(*map(tree_edges, rest))
    steps = zip(rest, rest[1:]) if kind == "sequence" else [(rest[0], rest[1]), (rest[1], rest[0])] if kind == "loop" else []
    return out | {(a, b) for x, y in steps for a in ends(x, True) for b in ends(y, False)}


def tree_graph(spark, tree: Tree) -> DataFrame:
    """Edges of the tree as a graph table: frequency 1, no anomaly, on the screen 'discovered'."""
    rows = [(f"discovered|{a}|null", f"discovered|{b}|null", 1, 0, 0.0) for a, b in sorted(tree_edges(tree))]
    return spark.createDataFrame(rows, "src string, dst string, frequency bigint, failure_count bigint, anomaly_score double")
