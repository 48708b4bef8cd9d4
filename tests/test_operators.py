import json
import math
import random
import uuid

import pytest
from helpers import S1, S2, event, log, opened, two_sessions
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.config import FoldConfig, ReportConfig
from pathloom.functions import scalar as X
from pathloom.functions.abstraction import abstract_args, abstract_value, compact, label_in
from pathloom.operators import align, evalrank, fold, gates, graph, patterns, process_tree, rules, summary
from pathloom.plans import ablation
from pathloom.sources.jsonl import read_events

CONFIG = FoldConfig()


def events_of(spark, tmp_path, lines):
    events, errors = read_events(spark, log(tmp_path, lines))
    assert errors.count() == 0
    return events


@pytest.mark.parametrize("value,label", [(0, "0"), (1, "1"), (2, "2-10"), (10, "2-10"), (11, "11-100"), (100, "11-100"), (101, "101-1000"), (1000, "101-1000"), (1001, "1001+"), (-5, "-2-10"), (-1, "-1"), (-(2**63), "-1001+")])
def test_bucket_labels(spark, value, label):
    assert label_in(CONFIG.bounds, value) == label
    assert spark.range(1).select(X.bucket_label(F.lit(value).cast("bigint"), CONFIG.bounds)).head()[0] == label


def test_string_classes(spark):
    cases = {"a@b.c": "email", "a@.c": "free", "@b.c": "free", "a@b": "free", str(uuid.uuid4()): "guid", "0123": "numeric", "": "free", "１": "free", "12\n": "free"}
    got = {r["s"]: r["c"] for r in spark.createDataFrame([(s,) for s in cases], "s string").select("s", X.string_class(F.col("s")).alias("c")).collect()}
    assert got == cases and {s: abstract_value(s, CONFIG)["class"] for s in cases} == cases


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=20), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=8), x, max_size=3), max_leaves=8)


@given(JSON)
@settings(max_examples=200, deadline=None)
def test_abstraction_is_idempotent(value):
    once = abstract_value(value, CONFIG)
    assert abstract_value(once, CONFIG) == once


def test_fast_and_deep_abstraction_agree(spark):
    config = FoldConfig(field_bounds={"n": (5, 50)})
    texts = ['{"k": 69}', '{"n":7,"a":-3}', "{}", None, "null", '{"n":{"x":7,"k":[60]}}', '{"_abstract":"string","email":"a@b.c"}', '{"a":1,"a":2}', '[1.9,"x"]', '{"b":true,"a":null}']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(abstract_args(F.col("t"), config)).collect()]
    assert got == ["null" if t is None else compact(abstract_value(json.loads(t), config)) for t in texts]


def test_uuid5_and_small_functions(spark):
    row = spark.range(1).select(X.uuid5(uuid.NAMESPACE_URL, F.lit("a/ö")), X.service_of(F.lit("my-svc-6f-x1")), X.service_of(F.lit("solo")), X.rfc3339_nanos(F.lit(1_000_000_001)), X.abnormal_window(F.lit("2022-08-22 23:59:10")), X.html_escape(F.lit("<a&'\">"))).head()
    assert tuple(row) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "a/ö")), "my-svc", "solo", "1970-01-01T00:00:01.000000001Z", "2022-08-22 24:01", "&lt;a&amp;&#39;&quot;&gt;")


def test_summary_and_fold_report(spark, tmp_path):
    events = events_of(spark, tmp_path, two_sessions())
    assert tuple(summary.summary(events).head()) == (2, 5, 1, 0.2)
    assert tuple(fold.fold_totals(fold.fold_report(events, CONFIG)).head()) == (5, 2, 0, 3, 0)
    assert {tuple(r) for r in fold.scenarios(events, CONFIG).select("screen", "command_id", "abstract_args").collect()} == {("Editor", "Doc.Recalculate", "{}"), ("Editor", "Doc.Save", "{}")}
    assert summary.summary(events.limit(0)).head()["error_rate"] == 0.0


def test_bursts_and_pauses(spark, tmp_path):
    lines = [event(0), event(1, at="12:00:00.010"), opened(2, at="12:00:00.020"), event(3, at="12:00:10"), event(4, at="12:00:09.999"), event(5, at="12:00:10.020")]
    events = events_of(spark, tmp_path, lines)
    kept = [r["seq"] for r in fold.scenarios(events, CONFIG).orderBy("action_idx").collect()]
    # 1 repeats 0; 3 is on another screen; 4 is earlier than 3; 5 repeats 4.
    assert kept == [0, 3, 4]
    assert fold.fold_report(events, CONFIG).head()["pauses"] == 1
    assert [r["seqs"] for r in fold.action_sources(events, CONFIG).orderBy("action_idx").collect()] == [[0, 1], [3], [4, 5]]


def test_graph_scores_and_exports(spark, tmp_path):
    lines = []
    for s in range(3):
        sid = f"00000000-0000-0000-0000-00000000000{s}"
        lines += [opened(0, session=sid), event(1, session=sid, command_id="A"), event(2, session=sid, at="12:00:09", command_id="B")]
    acts = graph.labelled(fold.scenarios(events_of(spark, tmp_path, lines), CONFIG))
    edges, nodes = graph.edges(acts).collect(), graph.nodes(acts).collect()
    assert [(r["frequency"], r["failure_count"], r["anomaly_score"]) for r in edges] == [(3, 0, (1 - 3 / 4) / 2)]
    assert graph.most_frequent_path(nodes, edges) == ["Editor|A|{}", "Editor|B|{}"] == graph.path_of_steps(graph.counted_steps(acts).collect())
    assert "N0 -->|freq=3| N1" in graph.to_mermaid(nodes, edges, 3) and 'N0 -> N1 [label="freq=3"]' in graph.to_dot(nodes, edges)
    assert graph.p80_frequency(graph.edges(acts.limit(0))).head()[0] == 1
    report = patterns.workflow_report(acts, summary.error_sessions(events_of(spark, tmp_path, lines)), ReportConfig(top_n=5))
    assert [(r["pattern"], r["support"]) for r in report["top_workflows"].collect()] == [(["Editor|A|{}"], 3), (["Editor|B|{}"], 3), (["Editor|A|{}", "Editor|B|{}"], 3)]


def sequences(spark, rows):
    return spark.createDataFrame([(str(s), i, 100 * s + i, c, c) for s, row in enumerate(rows) for i, c in enumerate(row)], "session_id string, action_idx bigint, _ord bigint, command_id string, action string")


def test_patterns_match_brute_force(spark):
    rng = random.Random(5)
    rows = [[rng.choice("abc") for _ in range(rng.randint(1, 6))] for _ in range(12)]
    support = {}
    for row in rows:
        found = {()}
        for c in row:
            found |= {(*p, c) for p in found if len(p) < 3}
        for p in found - {()}:
            support[p] = support.get(p, 0) + 1
    acts, want = sequences(spark, rows), {p: n for p, n in support.items() if n >= 3}
    for df in (patterns.frequent_patterns(acts, 3, 3), patterns.short_patterns(acts, 3, 3)):
        assert {tuple(r["pattern"]): r["support"] for r in df.collect()} == want
    assert patterns.frequent_patterns(acts, 0).count() == 0
    # No cap: a pattern of 17 actions, and a report with the default settings over it.
    long = sequences(spark, [list("abcdefghijklmnopq")] * 2 + [["z"]])
    only = patterns.frequent_patterns(sequences(spark, [["a"] * 17] * 2), 2)
    assert {len(r["pattern"]): r["support"] for r in only.collect()} == {n: 2 for n in range(1, 18)}
    assert patterns.frequent_patterns(long.filter("action_idx < 12"), 2).count() == 2**12 - 1


def test_report_mining_at_support_1(spark):
    rng = random.Random(9)
    rows = [[rng.choice("abcd") for _ in range(rng.randint(1, 6))] for _ in range(9)] + [list("abca")] * 2
    acts, bad = sequences(spark, rows), {"1", "4", "9", "10"}
    failing = spark.createDataFrame([(s,) for s in sorted(bad)], "session_id string")
    support, failed = {}, {}
    for s, row in enumerate(rows):
        found = {()}
        for c in row:
            found |= {(*p, c) for p in found}
        for p in found - {()}:
            support[p] = support.get(p, 0) + 1
            failed[p] = failed.get(p, 0) + (str(s) in bad)
    top = sorted((-n, len(p), p) for p, n in support.items())
    for n in (1, 7, 40, len(top), len(top) + 5):
        got = [(-r["support"], len(r["pattern"]), tuple(r["pattern"])) for r in patterns.top_workflows(acts, n).collect()]
        assert got == top[:n]
    rare = [(-failed[p] / n, len(p), p) for p, n in support.items() if n / len(rows) <= 0.3 and failed[p] / n >= 0.5]
    for n in (None, 3, 30):
        got = patterns.rare_failing(acts, failing, ReportConfig(rare_support=0.3, error_rate=0.5, rare_n=n)).collect()
        assert [(-r["error_rate"], len(r["pattern"]), tuple(r["pattern"])) for r in got] == sorted(rare)[:n]
        assert all(r["support"] == support[tuple(r["pattern"])] for r in got)
    assert patterns.rare_failing(acts.limit(0), failing).count() == 0 and patterns.top_workflows(acts.limit(0), 3).count() == 0


def test_the_report_ends_on_long_sessions(spark):
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rng = random.Random(3)
    rows = [names] * 4 + [rng.sample(names, 60) for _ in range(6)] + [["zz"]] * 190
    acts = sequences(spark, rows)
    failing = spark.createDataFrame([("0",), ("5",)], "session_id string")
    report = patterns.workflow_report(acts, failing, ReportConfig(rare_support=0.01, rare_n=50))
    top, rare = report["top_workflows"].collect(), report["rare_failing"].collect()
    assert top[0]["pattern"] == ["zz"] and top[0]["support"] == 190 and len(top) == 20
    # Rare is in at most 2 of 200 sessions; the worst are in session 5 alone or in both.
    assert len(rare) == 50 and all(r["support"] <= 2 for r in rare) and rare[0]["error_rate"] == 1.0


def test_action_keys_are_unique(spark):
    rows = [("a|b", "c", "{}"), ("a", "b|c", "{}"), ("a", "b", "c|{}"), ("100%", "x", None), ("100%25", "x", "%0"), ("a%7Cb", "c", "{}"), ("a", "b", None)]
    keys = [r[0] for r in spark.createDataFrame(rows, "screen string, command_id string, abstract_args string").select(graph.label()).collect()]
    assert len(set(keys)) == len(rows)
    assert [tuple(graph.parts_of(k)) for k in keys] == [tuple(x or "" for x in r) for r in rows]


def test_archive_keeps_the_newest(spark, tmp_path):
    from pathloom.sources import archive

    day = lambda d: f"timestamp'2024-01-0{d} 10:00:00'"
    path = f"file://{tmp_path}/store"
    first = spark.sql(f"SELECT * FROM VALUES ('s', 1L, {day(2)}, 'old'), ('s', 2L, {day(3)}, 'old'), ('t', 1L, {day(2)}, 'old') AS t(session_id, seq, ts, kind)")
    later = spark.sql(f"SELECT * FROM VALUES ('s', 2L, {day(3)}, 'new'), ('s', 0L, {day(1)}, 'new') AS t(session_id, seq, ts, kind)")
    archive.write_archive(first, path)
    archive.write_archive(first, path)
    archive.write_archive(later, path)
    want = [("s", 0, "new", "2024-01-01"), ("s", 1, "old", "2024-01-01"), ("s", 2, "new", "2024-01-01"), ("t", 1, "old", "2024-01-02")]
    archive.compacted(spark, path, f"{path}-2")
    for place in (path, f"{path}-2"):
        assert [(r["session_id"], r["seq"], r["kind"], str(r["dt"])) for r in archive.read_archive(spark, place).orderBy("session_id", "seq").collect()] == want
    assert len(archive.ingests(spark, path)) == 3 and len(archive.ingests(spark, f"{path}-2")) == 1


def test_union_of_windows(spark):
    one = spark.createDataFrame([("s", 5), ("s", 9)], "session_id string, _ord bigint")
    both = fold.union_windows([one, one]).orderBy("_ord").collect()
    assert [(r["window"], r["_ord"]["at"]) for r in both] == [(0, 5), (0, 9), (1, 5), (1, 9)]


def test_pod_latency_and_texts(spark):
    from pathloom.operators import rca

    spans = spark.createDataFrame([(0, "p", "", "a-1-x", 10_000_000), (1, "c", "p", "b-1-x", 4_000_000), (2, "d", "p", "b-1-x", 2_000_000), (3, "e", "p", "b-1-x", 0)], "row bigint, span_id string, parent_id string, pod string, end_ns bigint")
    assert sorted(tuple(r) for r in rca.latency_pairs(spans).collect()) == [("b-1-x", 1, 0, 6.0), ("b-1-x", 2, 0, 8.0), ("b-1-x", 3, 0, 10.0)]
    pods, limits = spark.createDataFrame([("a-1-x", "a"), ("b-1-x", "b"), ("c-1-x", "c")], "pod string, service string"), spark.createDataFrame([("c", 7.5)], "service string, value double")
    got = {r["pod"]: (r["n_samples"], r["p90"], r["source"]) for r in rca.pod_latency(spans, limits, pods).collect()}
    assert got == {"a-1-x": (0, 10.0, "trace-derived-p90"), "b-1-x": (3, pytest.approx(9.6), "trace-derived-p90"), "c-1-x": (0, 7.5, "fallback-threshold")}
    lists = spark.createDataFrame([("log:7",), ("log:8",), ("alert:Cpu",), ("span:a b",)], "src string")
    templates = spark.createDataFrame([(7, "user <*> failed")], "cluster_id int, template string")
    told = {r["src"]: r["t"] for r in evalrank.action_text(lists, "src", templates, "t").collect()}
    assert told == {"log:7": "user <*> failed", "log:8": "", "alert:Cpu": "Cpu", "span:a b": "span:a b"}
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, None), (3, 3)], "left_rank int, right_rank int")
    told = evalrank.paired_statistics(pairs)
    assert (told["cases"], told["b"], told["c"], told["p"]) == (4, 2, 1, 1.0) and told["low"] <= told["mean_difference"] <= told["high"]


@pytest.mark.parametrize("rows,shown", [([["A"]], "A"), ([["A", "B", "C"]] * 2, "→(A, B, C)"), ([["A"], ["B"]], "×(A, B)"), ([["A", "B", "A", "B"]], "↺(A, B)"), ([["A", "B", "C", "A", "D"], ["B", "A"]], None)])
def test_process_trees(spark, rows, shown):
    tree = process_tree.discover(sequences(spark, rows))
    assert process_tree.display(tree) == shown if shown else tree[0] in ("flower", "loop")
    assert process_tree.tree_edges(("sequence", ("activity", "A"), ("flower", "B", "C"))) == {("A", "B"), ("A", "C"), ("B", "B"), ("B", "C"), ("C", "B"), ("C", "C")}


def plain_tree(log, names, least):
    """The miner's definition over a whole log in memory."""
    if len(names) < 2:
        return ("activity", *names) if names else ("tau",)
    counts = {}
    for v in log:
        for pair in zip(v, v[1:]):
            counts[pair] = counts.get(pair, 0) + 1
    part = process_tree.Part(frozenset(names), {p for p, n in counts.items() if n >= least}, {v[0] for v in log}, {v[-1] for v in log})
    kind, children = process_tree.cut(part)
    below = [[short for v in log if (short := [c for c in v if c in own])] for own in children]
    return (kind, *([plain_tree(x, own, least) for x, own in zip(below, children)] or sorted(names)))


def test_process_trees_match_a_plain_miner(spark):
    rng = random.Random(4)
    for least, kind in [(1, "flat"), (1, "nested"), (2, "nested"), (1, "loops"), (3, "flat")]:
        rows = []
        for _ in range(14):
            a, b = rng.choice([("AB", "CD"), ("CD", "AB")]), "EF"
            one = [*rng.choice(["PQ", "QP", "P", "RS"]), *rng.choice(["XY", "X", "Z"])]
            rows.append({"flat": rng.choices("ABCDE", k=rng.randint(1, 5)), "nested": one, "loops": [*a[0], *b] * rng.randint(1, 3) + list(a[1])}[kind])
        want = plain_tree(rows, {c for v in rows for c in v}, least)
        assert process_tree.discover(sequences(spark, rows), process_tree.InductiveConfig(min_count=least)) == want
    assert process_tree.discover(sequences(spark, [["A"]]).limit(0)) == ("tau",)
    with pytest.raises(ValueError, match="more than 2"):
        process_tree.discover(sequences(spark, [list("ABCA")]), process_tree.InductiveConfig(max_edges=2))


def violations(rule, events):
    return [(r["message"], r["evidence"]) for r in rule.violations(events).orderBy("evidence").collect()]


def test_rules(spark, tmp_path):
    lines = [
        opened(0, "A"), event(1), opened(2, "SaveErrorModal"), event(3, kind="NavigationOccurred", **{"from": "x", "to": "A"}),
        event(4, kind="ValidationFailed", validator="v", field_id="f", reason="r"), event(5, kind="ValidationFailed", validator="v", field_id="g", reason="r"), event(6, command_id="Doc.Submit", outcome="cancelled"),
        event(7, command_id="Doc.Submit"), event(8, kind="ExceptionThrown", exception_type="BadNegative", message="m"), opened(0, "A", session=S2),
    ]
    events = events_of(spark, tmp_path, lines)
    assert violations(rules.NoUnhandledException(), events) == [("Unhandled exception: BadNegative: m", [8])]
    assert violations(rules.NoErrorModalAfterCommand(), events) == [("Error/Modal screen 'SaveErrorModal' opened after command (seq 1)", [1, 2])]
    assert violations(rules.CommandMustSucceed(("Doc.Submit",)), events) == [("Command 'Doc.Submit' did not succeed (seq 6)", [6])]
    assert violations(rules.CommandMustSucceed(), events) == []
    assert violations(rules.ScreenMustNavigateForward(), events) == [("Navigation revisited screen 'A' (seq 3)", [3])]
    assert violations(rules.ValidationsPassBeforeSubmit(), events) == [("Submit command 'Doc.Submit' fired with 2 outstanding validation failure(s)", [4, 5, 6])]
    assert [e for _, e in violations(rules.SuccessThenException("Doc.Submit", "Negative"), events)] == [[7, 8]]
    engine = rules.Engine()
    results = engine.results(events)
    assert results.count() == 10 and rules.exit_code(results) == 2
    assert {tuple(r) for r in engine.sessions(events).collect()} == {(S1, False, "Critical"), (S2, True, None)}
    text = rules.render_text(engine, events)
    assert text.startswith("sessions: 2  passed: 1  failed: 1\n  [FAIL] session=") and "       Critical: Unhandled exception: BadNegative: m" in text
    assert "BadNegative" in rules.render_html(engine, events)
    told = [json.loads(r["value"]) for r in rules.json_lines(engine, events).collect()]
    assert [t["session_id"] for t in told] == [S1, S2] and [r["rule"] for r in told[0]["results"]] == [r.name for r in engine.rules]
    assert told[0]["results"][0]["violations"][0]["evidence"] == [8] and all(r["passed"] for r in told[1]["results"])


def plain_alignment(a, b, overrides):
    """The whole table in fractions, and the same order of ways back."""
    from fractions import Fraction as Q

    def cost(x, y):
        if overrides and (c := overrides.get((x, y), overrides.get((y, x)))) is not None:
            return Q(str(c))
        return Q(0) if x == y else Q(2, 5) if x.split(":")[0] == y.split(":")[0] else Q(1)

    gap = Q(3, 5)
    t = [[gap * (i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = min(t[i][j] + cost(x, y), t[i][j + 1] + gap, t[i + 1][j] + gap)
    i, j, out = len(a), len(b), ""
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + cost(a[i - 1], b[j - 1]):
            out, i, j = ("M" if cost(a[i - 1], b[j - 1]) == 0 else "S") + out, i - 1, j - 1
        elif i and t[i][j] == t[i - 1][j] + gap:
            out, i = "D" + out, i - 1
        else:
            out, j = "I" + out, j - 1
    return float(t[-1][-1]), out


def test_alignment_matches_the_whole_table():
    rng = random.Random(3)
    labels = ["a:1", "a:2", "b:1", "b:2", "c"]
    for _ in range(300):
        a, b = ([rng.choice(labels) for _ in range(rng.randint(0, 14))] for _ in range(2))
        overrides = {(rng.choice(labels), rng.choice(labels)): rng.choice([0.0, 0.1, 0.7, 1.3]) for _ in range(rng.choice([0, 0, 3]))}
        cost, script = align.align_labels(a, b, overrides)
        want = plain_alignment(a, b, overrides)
        assert cost == pytest.approx(want[0]) and script == want[1], (a, b, overrides)
        for limit in (cost, cost + 0.5, rng.uniform(0, 6)):
            assert align.align_labels(a, b, overrides, limit) == ((cost, script) if cost <= limit + 1e-9 else None)
    a = [f"k:{i % 97}" for i in range(3000)]
    cost, script = align.align_labels(a, a[::-1])
    assert len(script) >= 3000 and cost == pytest.approx(0.4 * script.count("S") + 0.6 * (script.count("I") + script.count("D")))


def test_alignment_and_nearest(spark, tmp_path):
    assert align.align_labels(["k:a"], ["k:a"]) == (0.0, "M")
    assert align.align_labels(["k:a"], ["k:b"]) == (0.4, "S")
    assert align.align_labels(["k:a"], ["j:b"]) == (1.0, "S")
    assert align.align_labels([], ["k:a"]) == (0.6, "I")
    assert align.align_labels(["k:a"], ["k:b"], {("k:b", "k:a"): 0.1}) == (0.1, "S")
    events = events_of(spark, tmp_path, two_sessions())
    r = align.align_sessions(events, S1, S2).head()
    assert r["script"].count("M") == 1 and r["ops"] == 3
    assert [x["session_id"] for x in align.nearest(events, S1, 5).collect()] == [S2]
    assert align.nearest(events, "none", 5).count() == 0 and align.nearest(events, S1, 0).count() == 0
    with pytest.raises(LookupError):
        align.align_sessions(events, S1, "none")


def test_rank_semantics(spark):
    lists = spark.createDataFrame([("c", 1, 0.9, 2, "x"), ("c", 2, 0.9, 2, "x"), ("c", 3, 0.9, 2, "y"), ("c", 4, 0.5, 2, "z"), ("c", 5, 0.9, 2, "w")], "case_id string, pos bigint, score double, depth int, service string")
    assert [r["rank"] for r in evalrank.dense_rank_runs(lists).orderBy("pos").collect()] == [1, 1, 1, 2, 3]
    assert {r["service"]: r["rank"] for r in evalrank.service_rank(lists).collect()} == {"x": 1, "y": 1, "z": 2, "w": 3}
    assert evalrank.mcnemar_p(0, 0) == 1.0 and evalrank.mcnemar_p(1, 9) == pytest.approx(2 * 11 / 1024)
    low, high = evalrank.bootstrap_ci_of(spark.createDataFrame([(1, 1), (1, None), (1, None)], "left_rank int, right_rank int"), 200)
    assert 0 <= low <= high <= 1
    same = spark.createDataFrame([("a", 1), ("a", 2)], "k string, rank int")
    with pytest.raises(Exception, match="key comes twice"):
        evalrank.paired(same, same, ["k"]).collect()


def telemetry(spark, first, sessions, commands):
    rows = [(f"s{first + s}", s * 10 + i, (first + s) * 10 + i, 1_000_000 * (s * 10 + i), c) for s in range(sessions) for i, c in enumerate(commands)]
    events = spark.createDataFrame(rows, "session_id string, seq long, _ord long, at long, command_id string")
    none = F.lit(None).cast("string")
    return events.withColumns({"kind": F.lit("CommandExecuted"), "ts": F.timestamp_micros("at"), "screen_id": none, "nav_to": none, "args": F.lit("{}")}).drop("at")


def test_ablations(spark):
    normal = telemetry(spark, 0, 8, ["span:a", "log:1", "span:b", "alert:cpu"])
    abnormal = telemetry(spark, 100, 2, ["span:a", "span:b"])
    pods = normal.select("_ord", F.lit("pod-1").alias("pod"))
    alarms = spark.createDataFrame([], "pod string, resource string")
    found = ablation.ablations(normal, abnormal, pods, alarms).orderBy("variant", "pos").collect()
    told = [(r["variant"], *(graph.parts_of(r[c])[1] for c in ("src", "dst")), r["score"]) for r in found]
    assert told == [
        ("no-alerts", "span:a", "log:1", 1.0),
        ("no-logs", "span:b", "alert:cpu", 1.0), ("no-logs", "span:a", "span:b", 0.8),
        ("no-spans", "log:1", "alert:cpu", 1.0),
    ]


def test_drop_commands_renumbers(spark):
    kept = fold.drop_commands(telemetry(spark, 0, 1, ["log:1", "span:a", "log:2", "span:b"]), ["log:"]).orderBy("_ord").collect()
    assert [(r["seq"], r["command_id"]) for r in kept] == [(0, "span:a"), (1, "span:b")]


def test_order_stability(spark):
    first = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "src string, pos int")
    second = spark.createDataFrame([("a", 1), ("c", 2), ("d", 3)], "src string, pos int")
    assert gates.order_stability(first, first, ["src"]).count() == 0
    assert {tuple(r) for r in gates.order_stability(first, second, ["src"]).collect()} == {("b", 2, None), ("c", 3, 2), ("d", None, 3)}


def test_bootstrap_takes_all_pairs(spark):
    # The first 56 pairs are equal; only those after them differ.
    pairs = spark.createDataFrame([(1, 1)] * 56 + [(1, 2)] * 300 + [(None, 4)] * 44, "left_rank int, right_rank int")
    differences = [0.0] * 56 + [0.5] * 300 + [-0.25] * 44
    low, high = evalrank.bootstrap_ci_of(pairs)
    assert low < sum(differences) / 400 < high
    # For so many cases the mean is nearly normal.
    mean = sum(differences) / 400
    spread = 1.96 * math.sqrt(sum((d - mean) ** 2 for d in differences)) / 400
    assert (low, high) == pytest.approx((mean - spread, mean + spread), abs=0.004)
    assert evalrank.bootstrap_ci_of(pairs.limit(0)) == (None, None)


def test_edge_ranking_fails_closed(spark):
    from pathloom.config import ScoreConfig
    from pathloom.operators import rca

    rows = [["span:a", "x"]] * 7 + [["span:a", "y"]] * 6
    normal, abnormal = sequences(spark, rows), sequences(spark, [["span:a", "y"]])
    normal, abnormal = (x.withColumn("action", F.concat(F.lit("s|"), "command_id", F.lit("|"))) for x in (normal, abnormal))
    pods = normal.select("_ord", F.lit("p").alias("pod"))
    alarms = spark.createDataFrame([], "pod string, resource string")
    edges, other = graph.edges(normal), graph.edges(abnormal)
    found = rca.graph_root_causes(normal, pods, alarms, edges, other, ScoreConfig()).orderBy("pos").collect()
    assert [(r["dst"], r["score"], r["depth"]) for r in found] == [("s|x|", 1.0, 1), ("s|y|", 6 / 7, 1)]
    foreign = edges.unionByName(edges.limit(1).withColumn("dst", F.lit("s|never|")))
    with pytest.raises(Exception, match="not met in the normal scenarios: s.span:a. to s.never"):
        rca.graph_root_causes(normal, pods, alarms, foreign, other, ScoreConfig()).collect()


def test_nearest_search_prunes(spark):
    from pathloom.sources.events_view import trace_view

    rng = random.Random(6)
    rows = [(f"s{s:03d}", 100 * s + i, rng.choice(["Doc.Save", "Doc.Open", "App.Quit"])) for s in range(60) for i in range(rng.randint(1, 9))]
    events = spark.createDataFrame(rows, "session_id string, _ord bigint, command_id string").withColumn("kind", F.lit("CommandExecuted"))
    events = events.withColumns({c: F.lit(None).cast("string") for c in ("screen_id", "field_id", "exception_type", "validator", "operation_id", "nav_from", "nav_to")})
    for overrides in (None, {("CommandExecuted:Doc.Save", "CommandExecuted:App.Quit"): 0.1, ("CommandExecuted:Doc.Open", "CommandExecuted:Doc.Open"): 0.3}):
        for n in (1, 5, 80):
            want = align.nearest_by_scan(events, "s007", n, overrides).collect()
            assert align.nearest_counted(events, "s007", n, overrides, first=1).found.collect() == want
    real = trace_view(spark, "/root/testdata/sf0.01")
    longest = real.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").head()["session_id"]
    got = align.nearest_counted(real, longest, 10)
    assert got.found.collect() == align.nearest_by_scan(real, longest, 10).collect()
    assert 10 <= got.aligned < got.sessions / 10, got


def test_alarm_proofs_close(spark, tmp_path):
    from pathloom.operators.alarms import alarm_proofs
    from pathloom.sources.telemetry import read_metrics

    (tmp_path / "a-1-x_metric.csv").write_text("Time,TimeStamp,PodName,CpuUsageRate(%),MemoryUsageRate(%)\n2022-08-22 03:51:00,1,a-1-x,91.5,n/a\n2022-08-22 03:52:00,2,a-1-x,91.5,7\n2022-08-22 03:52:30,2,a-1-x,12,7\n")
    metrics = read_metrics(spark, f"file://{tmp_path}/*.csv")
    assert sorted(tuple(r) for r in metrics.select("pod", "time", "metric_type", "value").collect())[0] == ("a-1-x", "2022-08-22 03:51:00", "CpuUsageRate(%)", 91.5)
    assert metrics.count() == 5
    spans = spark.createDataFrame([(0, "p", None, "b-1-x", 50_000_000), (1, "c1", "p", "a-1-x", 40_000_000), (2, "c2", "p", "a-1-x", 38_000_000), (3, "c3", "p", "a-1-x", 20_000_000)], "row long, span_id string, parent_id string, pod string, end_ns long")
    thresholds = spark.createDataFrame([("c", 7.5)], "service string, value double")

    def proofs(*rows):
        alarms = spark.createDataFrame(rows, "pod string, metric_type string, value double")
        return {(r["pod"], r["metric_type"]): r for r in alarm_proofs(alarms, metrics, "2022-08-22 03:52", spans, thresholds, "t.csv").collect()}

    good = [("a-1-x", "CpuUsageRate(%)", 91.5), ("a-1-x", "NetworkP90(ms)", 26.4), ("c-1-x", "NetworkP90(ms)", 7.5), ("b-1-x", "NetworkP90(ms)", 10.0)]
    got = proofs(*good)
    assert {k: (r["kind"], r["n_samples"], len(r["inputs"])) for k, r in got.items()} == {
        good[0][:2]: ("metric-sample", 1, 1), good[1][:2]: ("trace-derived-p90", 3, 3), good[2][:2]: ("fallback-threshold", 0, 1), good[3][:2]: ("trace-derived-p90", 0, 0)}
    assert got[good[1][:2]]["inputs"][0]["parent_row"] == 0 and got[good[0][:2]]["inputs"][0]["file"] == "a-1-x_metric.csv"
    for bad, text in ((("b-1-x", "CpuUsageRate(%)", 91.5), "no metric row"), (("a-1-x", "MemoryUsageRate(%)", 8.0), "no metric row"), (("a-1-x", "NetworkP90(ms)", 26.0), "another value than derived"), (("z-1-x", "NetworkP90(ms)", 1.0), "another value"), (("front-1-x", "NetworkP90(ms)", 10.0), "cannot alarm"), (("b-1-x", "CpuUsageRate(%)", None), "no value")):
        with pytest.raises(Exception, match=text):
            proofs(good[0], bad)


def test_ranking_log_keeps_every_case(spark, tmp_path):
    from pathloom.operators import ranking_log
    from pathloom.sources.jsonl import read_lines

    good = "{'score': 1.0, 'deepth': 2, 'pod': 'svc-1-x', 'resource': 'CpuUsage'}"
    other = "{'score': 0.7, 'deepth': 1, 'pod': 'db-1-x', 'events': '1_2'}"
    when = "2022-08-22 03:51"
    lines = [
        f"{when} Inject Ground Truth: lost-1-x, cpu",  # before any header: nobody's
        f"[INFO] Soted Result List: [{good}]", f"x Soted Result List: [{other}, {good}]  ", f"{when}:10 Inject RCA Result:", f"{when} Inject Ground Truth: svc-1-x, cpu score 2", f"{when} Inject Ground Truth: svc-1-x, cpu",
        f"{when} Inject RCA Pod Result:", f"{when} Inject Ground Truth: svc-1-x, cpu",  # no list since the last header
        f"Soted Result List: [{good}]", "Soted Result List: [{'score': ]", f"{when} Inject RCA Result:", f"{when} Inject Ground Truth: svc-1-x, cpu",
        "Soted Result List: [{'score': 1.0, 'pod': 'svc-1-x'}]", f"{when} Inject RCA Result:", f"{when} Inject Ground Truth: svc-1-x, cpu",
        "Soted Result List: [1]", f"{when} Inject RCA Result:",
        f"Soted Result List: [{good}]", f"{when} Inject RCA Result:", f"{when} Inject Ground Truth: svc-1-x, disk",
        "Soted Result List: []", f"{when} Inject RCA Result:", f"{when} Inject Ground Truth: svc-1-x, code",
        f"Soted Result List: [{other}]", f"{when} Inject RCA Result:", f"{when} Inject Ground Truth: db-1-x, code",
        f"Soted Result List: [{good}]",  # after the last header: nobody's
    ]
    truths = spark.createDataFrame([("svc-1-x", "cpu", ["Cpu"]), ("svc-1-x", "code", ["open", "close"]), ("db-1-x", "code", ["open", "close"])], "inject_pod string, inject_type string, parts array<string>")
    templates = spark.createDataFrame([("1", "open file"), ("2", "close file")], "id string, template string")
    cases = ranking_log.log_cases(read_lines(spark, log(tmp_path, lines, "rank.log")))
    found = ranking_log.evaluated_log(cases, truths, templates).orderBy("case").collect()
    assert [(r["status"], r["n_candidates"], r["rank_inner"], r["rank_service_raw"], r["claimed_rank"]) for r in found] == [
        ("ok", 2, 2, 2, 2), ("no list", None, None, None, None), ("unreadable list", None, None, None, None), ("candidate defect", None, None, None, None),
        ("candidate defect", None, None, None, None), ("no truth", 1, None, None, None), ("ok", 0, None, None, None), ("ok", 1, 1, 1, None)]
    assert evalrank.accuracy(ranking_log.evaluated_log(cases, truths, templates).withColumnRenamed("rank_inner", "rank")).head()["cases"] == 8
    assert found[0]["query_time"] == "2022-08-22 03:51:10"


def test_rule_mining(spark):
    from pathloom.operators import rule_mining

    rng = random.Random(12)
    rows = [[rng.choice("abcde") for _ in range(rng.randint(1, 6))] for _ in range(40)] + [list("xy")] * 5 + [list("yx")]
    events = sequences(spark, rows).withColumns({"seq": F.col("action_idx"), "kind": F.lit("CommandExecuted")})
    want = {}
    for a in "abcdexy":
        for b in set("abcdexy") - {a}:
            for rule, about in (("response", a), ("precedence", b), ("absence", a + b)):
                hit = [row for row in rows if set(about) <= set(row)]
                keep = {
                    "response": lambda r: all(b in r[i:] for i, c in enumerate(r) if c == a),
                    "precedence": lambda r: all(a in r[:i] for i, c in enumerate(r) if c == b),
                    "absence": lambda r: all(b not in r[i:] for i, c in enumerate(r) if c == a),
                }[rule]
                good = sum(map(keep, hit))
                together = any({a, b} <= set(row) for row in rows)
                if together and len(hit) >= 3 and good / len(hit) >= 0.3:
                    want[rule, a, b] = (len(hit), good)
    found = rule_mining.mine(events, 3, 0.3)
    assert {(r["rule"], r["a"], r["b"]): (r["sessions"], r["satisfied"]) for r in found.collect()} == want
    mined = rule_mining.as_rules(found)
    told = rules.Engine(mined).violations(events).groupBy("rule").count().collect()
    names = {r.name: want[r.rule, r.a, r.b] for r in mined}
    assert {r["rule"]: r["count"] for r in told} == {n: s - good for n, (s, good) in names.items() if s > good}
    broken = {r["session_id"]: list(r["evidence"]) for r in rule_mining.MinedRule("response", "x", "y").violations(events).collect()}
    assert broken == {"45": [1]}
    assert rule_mining.mine(events.limit(0)).count() == 0


def test_error_prone_actions(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "err"), ("d", "c"), ("c", "c"), ("err", "a"), ("far", "a"), ("x", "y")], "src string, dst string")
    got = {r["action"]: (r["distance"], r["weight"]) for r in graph.error_prone(edges, spark.createDataFrame([("err",)], "action string"), 0.5, 0.1).collect()}
    assert got == {"err": (0, 1.0), "c": (1, 0.5), "b": (2, 0.25), "d": (2, 0.25), "a": (3, 0.125)}
    assert graph.error_prone(edges, edges.select(F.col("src").alias("action")).limit(0)).count() == 0


def test_latency_percentiles_are_exact(spark):
    """Against the percentile over all values, with ties, with few samples, and where the bounds miss it."""
    from pathloom.operators import rca

    n = F.col("id")
    calls = spark.range(40_000).select(
        F.when(n < 3, "few").when(n < 5, "two").when(n < 7, "none").when(n % 3 == 0, "ties").when(n % 3 == 1, "wide").otherwise("one").alias("pod"), n.alias("child_row"), F.lit(0).cast("bigint").alias("parent_row"),
        F.when((n >= 5) & (n < 7), None).when(n % 3 == 0, F.pmod(F.hash("id"), F.lit(5))).when(n % 3 == 1, F.exp(F.pmod(F.hash("id"), F.lit(60_000)) / 1000) - 7.0).otherwise(4.0).cast("double").alias("ms"))
    calls = calls.unionByName(calls.filter("pod = 'wide'").limit(100).withColumn("ms", F.lit(None).cast("double")))
    want = {r["pod"]: (r["n"], r["p"] if r["n"] > 2 else 10.0) for r in calls.groupBy("pod").agg(F.count("*").alias("n"), F.percentile("ms", F.lit(0.9)).alias("p")).collect()}
    assert set(want) == {"few", "two", "none", "ties", "wide", "one"}
    for near, few in ((rca.NEAR, rca.FEW), (rca.NEAR, 1_000), (-0.05, 1_000)):
        assert {r["pod"]: (r["n_samples"], r["p90"]) for r in rca.percentiles(calls, 10.0, near, few).collect()} == want


def test_alarm_closure_gathers_no_pod(spark, tmp_path):
    """The rows of a proof are counted and listed as rows: no aggregate holds all of a pod's."""
    import duckdb

    from pathloom import queries
    from pathloom.operators import alarms, rca

    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES["alarm_closure"](spark, sf)
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["alarm_closure"])
    names = [d[0] for d in cursor.description]
    assert found.columns == names and sorted(map(tuple, found.collect())) == sorted(cursor.fetchall())
    plans = found._jdf.queryExecution().optimizedPlan().toString(), rca.latency_p90(spark.createDataFrame([(0, "p", "", "a", 1)], "row bigint, span_id string, parent_id string, pod string, end_ns bigint"))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for plan in plans for x in ("collect_list", "percentile("))
    metrics = spark.createDataFrame([("m", 4, "t1", "a-1-x", "CpuUsageRate(%)", 91.5), ("m", 5, "t1", "a-1-x", "CpuUsageRate(%)", 91.5), ("m", 6, "t1", "a-1-x", "CpuUsageRate(%)", 9.0), ("m", 7, "t2", "a-1-x", "CpuUsageRate(%)", 91.5)], "file string, row long, time string, pod string, metric_type string, value double")
    spans = spark.createDataFrame([(0, "p", None, "b-1-x", 50_000_000), (1, "c1", "p", "a-1-x", 40_000_000), (2, "c2", "p", "a-1-x", 38_000_000), (3, "c3", "p", "a-1-x", 20_000_000)], "row long, span_id string, parent_id string, pod string, end_ns long")
    thresholds = spark.createDataFrame([("c", 7.5)], "service string, value double")
    told = spark.createDataFrame([("a-1-x", "CpuUsageRate(%)", 91.5), ("a-1-x", "NetworkP90(ms)", 26.4), ("c-1-x", "NetworkP90(ms)", 7.5), ("b-1-x", "NetworkP90(ms)", 10.0)], "pod string, metric_type string, value double")
    args = (told, metrics, "t1", spans, thresholds)
    lists = alarms.alarm_proofs(*args, "t.csv")
    rows = sorted(map(tuple, alarms.alarm_inputs(*args, "t.csv").collect()), key=str)
    assert rows == sorted(map(tuple, lists.select("pod", "metric_type", F.inline("inputs")).collect()), key=str) and len(rows) == 6
    assert sorted(map(tuple, alarms.alarm_counts(*args).collect())) == sorted(map(tuple, lists.withColumn("inputs", F.size("inputs").cast("bigint")).collect()))
    with pytest.raises(Exception, match="no metric row"):
        alarms.alarm_counts(told, metrics, "t3", spans, thresholds).collect()
