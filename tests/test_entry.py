"""Queries against their SQL twins on the smallest tables, and the command line."""

import io
import json
import math
import os
import sys

import duckdb
import pytest
from helpers import event, log, two_sessions

from pathloom import cli
from pathloom import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = ["corpus_summary", "edge_anomaly", "fold_report", "rule_validations", "rule_results", "rare_failing", "similar_sessions", "historical_rank", "conservation_check", "p90_threshold", "canonical_actions", "diagnostic_counts", "action_keys", "ingest_twice", "rca_first_alarms", "evaluated_cases", "order_stability"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(str(None if isinstance(r[i], float) and math.isnan(r[i]) else round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, cursor = core.QUERIES[name](spark, SF), con.execute(core.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_patterns_of_all_lengths(spark):
    """Against a miner that lists every subsequence of every session."""
    from collections import Counter
    from itertools import combinations

    from pathloom.operators import patterns, summary
    from pathloom.sources.events_view import trace_view

    sf = "/root/testdata/sf0.01"
    sequences = {r["session_id"]: r["actions"] for r in patterns.sequences(core.acts(spark, sf)).collect()}
    bad = {r["session_id"] for r in summary.error_sessions(trace_view(spark, sf)).collect()}
    support, failing = Counter(), Counter()
    for session, actions in sequences.items():
        for p in {c for n in range(1, len(actions) + 1) for c in combinations(actions, n)}:
            support[p] += 1
            failing[p] += session in bad
    often = {" > ".join(p): n for p, n in support.items() if n >= 5}
    assert {r["pattern"]: r["support"] for r in core.QUERIES["frequent_patterns_full"](spark, sf).collect()} == often
    top = sorted((-n, len(p), p) for p, n in support.items())[:20]
    assert [(r["pattern"], r["support"]) for r in core.QUERIES["top_workflows_full"](spark, sf).collect()] == [(" > ".join(p), -n) for n, _, p in top]
    rare = {" > ".join(p): n for p, n in support.items() if n >= 2 and n / len(sequences) <= 0.01 and failing[p] / n >= 0.05}
    assert {r["pattern"]: r["support"] for r in core.QUERIES["rare_failing_full"](spark, sf).collect()} == rare
    assert any(p.count(" > ") >= 2 for p in rare)
    worst = sorted((-failing[p] / n, len(p), p) for p, n in support.items() if n / len(sequences) <= 0.01 and failing[p] / n >= 0.05)
    told = [(r["pattern"], r["support"]) for r in core.QUERIES["rare_failing_report"](spark, sf).collect()]
    assert told == [(" > ".join(p), support[p]) for _, _, p in worst[:1000]]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(spark, tmp_path, capsys):
    path = log(tmp_path, two_sessions())
    assert cli.main(["analyze", path, "--output", "json"], spark) == 0
    assert capsys.readouterr().out == '{"sessions":2,"events":5,"errors":1,"error_rate":0.2,"per_kind":{"CommandExecuted":2,"ExceptionThrown":1,"ScreenOpened":2}}\n'
    assert cli.main(["normalize", path, "--report"], spark) == 0
    assert "fold report: input_events=5 output_actions=2 collapsed_bursts=0 dropped_noise=3 session_pauses=0" in capsys.readouterr().out
    assert cli.main(["oracle", path], spark) == 2
    capsys.readouterr()
    assert cli.main(["oracle", path, "--output", "json", "--rules", "demo"], spark) == 2
    told = json.loads(capsys.readouterr().out)
    assert len(told) == 2 and len(told[0]["results"]) == 6
    assert cli.main(["report", "workflows", path], spark) == 0
    assert "=== Top workflows ===" in capsys.readouterr().out
    with open(path, "rb") as f, pytest.MonkeyPatch.context() as m:
        m.setattr(sys, "stdin", io.TextIOWrapper(f))
        assert cli.main(["analyze", "-", "--output", "json"], spark) == 0
    assert '"events":5' in capsys.readouterr().out
    assert cli.main(["analyze", str(tmp_path / "none")], spark) == 66
    assert cli.main(["analyze", log(tmp_path, [event(0), "{torn"], "torn.jsonl")], spark) == 65
    assert cli.main(["graph", path, "--format", "process-tree"], spark) == 64
    assert cli.main(["nonsense"], spark) == 64
    assert cli.main(["ingest", path, "--db", str(tmp_path / "db")], spark) == 0
    assert cli.main(["ingest", path, "--db", str(tmp_path / "db")], spark) == 0
    capsys.readouterr()
    assert cli.main(["slice", str(tmp_path / "db"), "command", "Doc.Save"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 1
