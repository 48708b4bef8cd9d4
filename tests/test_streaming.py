import os
import random

from helpers import S2, event, log, opened

from pathloom.operators import rules
from pathloom.sources.jsonl import read_events
from pathloom.streaming.rules import revisited_screens, session_violations, stream_events, unhandled_exceptions


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    left = [s.get("numRowsTotal") for s in (q.lastProgress or {}).get("stateOperators", [])]
    q.stop()
    return spark.table(name).collect(), left


def aged(folder):
    """Files come in by age: that of each is set by its name."""
    for k, name in enumerate(sorted(os.listdir(folder))):
        os.utime(folder / name, (1_700_000_000 + 10 * k,) * 2)


#: Comes last, long after all others, so that the watermark passes them.
LATER = event(0, session="00000000-0000-0000-0000-00000000000f", at="23:59:00")


def test_streams(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log(folder, [opened(0, "A"), opened(1, "B"), event(2, kind="ExceptionThrown", exception_type="E", message="m"), opened(3, "A"), "{torn"])
    log(folder, [LATER], "z.jsonl")
    aged(folder)
    found, _ = run(spark, unhandled_exceptions(stream_events(spark, str(folder))), "bad", tmp_path)
    assert [r["message"] for r in found] == ["Unhandled exception: E: m"]
    found, _ = run(spark, revisited_screens(stream_events(spark, str(folder), 1)), "again", tmp_path)
    assert [(r["seq"], r["screen"]) for r in found] == [(3, "A")]


def test_session_rules_in_any_order(spark, tmp_path):
    """Batches of shuffled events give the rows of the batch rules, and the state goes."""
    at = "12:{:02d}:{:02d}"
    one = [
        opened(0, "A"), event(1, at=at.format(0, 1)), opened(2, "SaveErrorModal"),
        event(3, at=at.format(0, 3), kind="ValidationFailed", validator="v", field_id="f", reason="r"), event(4, at=at.format(0, 4), kind="ValidationFailed", validator="v", field_id="g", reason="r"),
        event(5, at=at.format(0, 5), command_id="Doc.Submit"), event(6, at=at.format(0, 6), kind="ExceptionThrown", exception_type="BadState", message="m"),
        event(7, at=at.format(0, 7), kind="NavigationOccurred", **{"from": "x", "to": "A"}), event(8, at=at.format(0, 8), command_id="Doc.Submit"),
    ]
    two = [event(0, session=S2, at=at.format(1, 0), kind="ValidationFailed", validator="v", field_id="f", reason="r"), event(1, session=S2, at=at.format(1, 1), kind="NavigationOccurred", **{"from": "x", "to": "B"}), event(2, session=S2, at=at.format(1, 2), command_id="Doc.Save"), event(3, session=S2, at=at.format(1, 3), kind="NavigationOccurred", **{"from": "x", "to": "B"})]
    asked = (rules.NoErrorModalAfterCommand(), rules.ScreenMustNavigateForward(), rules.ValidationsPassBeforeSubmit(), rules.SuccessThenException("Doc.Submit", "State"))
    events, _ = read_events(spark, log(tmp_path, [*one, *two]))
    key = lambda r: (r["session_id"], r["rule"], r["severity"], r["message"], tuple(r["evidence"]))
    want = sorted(key(r) for rule in asked for r in rule.violations(events).collect())
    assert len(want) == 5
    mixed = [*one, *two]
    random.Random(2).shuffle(mixed)
    folder = tmp_path / "shuffled"
    folder.mkdir()
    for k in range(0, len(mixed), 3):
        log(folder, mixed[k : k + 3], f"{k:02d}.jsonl")
    log(folder, [LATER], "99.jsonl")
    aged(folder)
    found, left = run(spark, session_violations(stream_events(spark, str(folder), 1), asked), "violations", tmp_path)
    assert sorted(map(key, found)) == want
    assert left and left[0] <= 8  # what is left is of the last session alone: its one waiting event, its time, its timers
