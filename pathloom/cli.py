"""Command line: ``python -m pathloom.cli VERB ...``.

Exit codes: 0 done; oracle 0, 1 or 2 by its worst finding; 64 usage; 65 bad data; 66 something missing; 74 unreadable.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FoldConfig, ReportConfig
from .operators import align, fold, graph, patterns, process_tree, rules, summary
from .plans.diagnostic import diagnostic_bundle
from .sources import archive, jsonl
from .sources.scratch import collected, scratch

#: Bytes of standard input that are held at a time.
STDIN_BLOCK = 1 << 20
OK, USAGE, DATA, MISSING, IO = 0, 64, 65, 66, 74


class Stop(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log ('-': standard input), which must be whole."""
    if path == "-":
        path = scratch(spark, "stdin")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log.jsonl")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        while block := sys.stdin.buffer.read(STDIN_BLOCK):
            out.write(bytearray(block))
        out.close()
    elif "://" not in path and not Path(path).exists():
        raise Stop(MISSING, f"no such file: {path}")
    events, errors = jsonl.read_events(spark, path, stage=True)
    bad = errors.orderBy("_ord").head(1)
    if bad:
        raise Stop(IO if bad[0]["error_class"] == "Io" else DATA, f"{bad[0]['error_class']}: {bad[0]['raw'][:200]}")
    return events


def _store(spark: SparkSession, path: str) -> DataFrame:
    if "://" not in path and not Path(path).exists():
        raise Stop(MISSING, f"no such store: {path}")
    return archive.read_archive(spark, path).withColumn("_ord", F.struct("session_id", "seq"))


def analyze(spark, a) -> int:
    events = _log(spark, a.file)
    row = summary.summary(events).head()
    kinds = {r["kind"]: r["n"] for r in summary.per_kind(events).orderBy("kind").collect()}
    if a.output == "json":
        print(jsonl.dumps({**row.asDict(), "per_kind": kinds}))
    else:
        print(f"sessions:   {row['sessions']}\nevents:     {row['events']}\nerrors:     {row['errors']}\nerror_rate: {row['error_rate']:.3f}\nper kind:")
        print("".join(f"  {k:<24} {n}\n" for k, n in kinds.items()), end="")
    return OK


def normalize(spark, a) -> int:
    events, config = _log(spark, a.file), FoldConfig()
    first = events.groupBy("session_id").agg(F.min("_ord").alias("first"))
    for r in fold.scenarios(events, config).join(first, "session_id").orderBy("first", "action_idx").toLocalIterator():
        print(jsonl.dumps({"screen_id": r["screen"], "command_id": r["command_id"], "abstract_args": json.loads(r["abstract_args"])}))
    if a.report:
        t = fold.fold_totals(fold.fold_report(events, config)).head()
        print(f"fold report: input_events={t['input_events']} output_actions={t['output_actions']} collapsed_bursts={t['bursts_collapsed']} dropped_noise={t['noise_dropped']} session_pauses={t['pauses']}")
    return OK


def _acts(events: DataFrame) -> DataFrame:
    return graph.labelled(fold.scenarios(events, FoldConfig()))


def graph_(spark, a) -> int:
    if a.format == "process-tree" and a.miner != "inductive":
        raise Stop(USAGE, "process trees need the inductive miner")
    acts = _acts(_log(spark, a.file))
    if a.miner == "inductive":
        tree = process_tree.discover(acts)
        if a.format == "process-tree":
            print(process_tree.display(tree))
            return OK
        edges = process_tree.tree_graph(spark, tree).collect()
        names = list(dict.fromkeys(x for e in edges for x in (e["src"], e["dst"])))
        nodes, p80 = [{"action": n, "first_seen": i, "visit_count": 1} for i, n in enumerate(names)], 1
    else:
        table = graph.edges(acts)
        nodes, edges = (collected(t, graph.MOST_DRAWN, f"{what} to draw") for t, what in ((graph.nodes(acts), "nodes"), (table, "edges")))
        p80 = graph.p80_frequency(table).head()["p80"]
    print(graph.to_mermaid(nodes, edges, p80) if a.format == "mermaid" else graph.to_dot(nodes, edges), end="")
    return OK


def report(spark, a) -> int:
    if a.what == "similar":
        for r in summary.similar_sessions(_store(spark, a.file), a.session, a.top).collect():
            print(f"{r['session_id']}  {r['score']:.4f}")
        return OK
    events = _log(spark, a.file)
    acts = _acts(events)
    found = patterns.workflow_report(acts, summary.error_sessions(events), ReportConfig(top_n=a.top))
    if a.output == "json":
        print(jsonl.dumps({k: [r.asDict(recursive=True) for r in v.collect()] for k, v in found.items()}))
    else:
        print(patterns.render_report(found, acts.count()), end="")
    return OK


def oracle(spark, a) -> int:
    events, engine = _log(spark, a.file), rules.Engine((*rules.BUILTIN, rules.DEMO) if a.rules == "demo" else rules.BUILTIN)
    told = rules.reported(engine, events)
    if a.html:
        with open(a.html, "w", encoding="utf-8") as out:
            out.writelines(line + "\n" for line in rules.html_lines(told))
    if a.output == "json":
        for i, r in enumerate(rules.json_of(told).toLocalIterator()):
            print(("," if i else "[") + r["value"], end="")
        print("]" if not events.isEmpty() else "[]")
    else:
        for line in rules.text_lines(told):
            print(line)
    return rules.exit_code_of(told)


def ingest(spark, a) -> int:
    events = _log(spark, a.file)
    archive.write_archive(summary.last_write_wins(events).drop("_ord"), a.db)
    print(f"{events.count()} events", file=sys.stderr)
    return OK


def slice_(spark, a) -> int:
    store = _store(spark, a.db)
    for r in summary.slice_by(store, a.dimension, a.value).select(jsonl.envelope(store).alias("line")).toLocalIterator():
        print(r["line"])
    return OK


def align_(spark, a) -> int:
    try:
        r = align.align_sessions(_store(spark, a.db), a.a, a.b).head()
    except LookupError as e:
        raise Stop(MISSING, str(e)) from e
    print(f"cost={r['cost']:.4f} match_rate={r['match_rate']:.4f} similarity={r['similarity']:.4f} script={r['script']}")
    return OK


def export(spark, a) -> int:
    try:
        row = diagnostic_bundle(_log(spark, a.file), a.session).head()
    except LookupError as e:
        raise Stop(MISSING, str(e)) from e
    print(json.dumps(row.asDict(recursive=True), default=str))
    return OK


def version(spark, a) -> int:
    print(jsonl.dumps(jsonl.version()))
    return OK


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name, f, *args):
        v = verbs.add_parser(name)
        v.set_defaults(run=f)
        for flags, options in args:
            v.add_argument(*flags, **options)

    file, output = (["file"], {}), (["--output"], {"choices": ["text", "json"], "default": "text"})
    verb("analyze", analyze, file, output)
    verb("normalize", normalize, file, (["--report"], {"action": "store_true"}))
    verb("graph", graph_, file, (["--format"], {"choices": ["mermaid", "dot", "process-tree"], "default": "mermaid"}), (["--miner"], {"choices": ["heuristics", "inductive"], "default": "heuristics"}))
    verb("report", report, (["what"], {"choices": ["workflows", "similar"]}), file, output, (["--session"], {}), (["--top"], {"type": int, "default": 20}))
    verb("oracle", oracle, file, output, (["--html"], {}), (["--rules"], {"choices": ["builtin", "demo"], "default": "builtin"}))
    verb("ingest", ingest, file, (["--db"], {"required": True}))
    verb("slice", slice_, (["db"], {}), (["dimension"], {"choices": ["session", "command", "screen", "outcome", "entity"]}), (["value"], {}))
    verb("align", align_, (["db"], {}), (["a"], {}), (["b"], {}))
    verb("export", export, file, (["--session"], {"required": True}))
    verb("version", version)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else USAGE
    try:
        return a.run(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)
    except Stop as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
