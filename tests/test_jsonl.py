import json

import pytest
from helpers import S1, event, log, opened
from pyspark.sql import functions as F

from pathloom.sources.jsonl import container_depth, read_events, write_events

ALL_KINDS = [
    opened(0, params={"b": [1, {"a": "x"}], "a": None}, correlation_id="11111111-2222-3333-4444-555555555555"),
    event(1, outcome="failure", detail={"message": "no"}, ts="2026-05-27T12:00:00.123456789Z"),
    event(2, kind="FieldChanged", field_id="f", old={"policy": "raw", "value": {"k": [1]}}, new={"policy": "hashed", "hash": "ab", "algo": "x"}),
    event(3, kind="ExceptionThrown", exception_type="E", message="m"),
    event(4, kind="NavigationOccurred", **{"from": "A", "to": "B"}),
    event(5, kind="ValidationFailed", validator="v", field_id="f", reason="r"),
    event(6, kind="AsyncOperationCompleted", operation_id="o", duration_ms=3, outcome="timed_out"),
    event(7, version=2, domain_entity_id="Entity:1", outcome="cancelled"),
]


def classes(spark, tmp_path, lines):
    _, errors = read_events(spark, log(tmp_path, lines))
    return {r["raw"]: r["error_class"] for r in errors.collect()}


def test_every_kind_reads_and_writes_back(spark, tmp_path):
    events, errors = read_events(spark, log(tmp_path, ALL_KINDS))
    assert errors.count() == 0
    rows = events.orderBy("_ord").collect()
    assert [r["seq"] for r in rows] == list(range(8))
    assert rows[0]["params"] == '{"a":null,"b":[1,{"a":"x"}]}' and rows[1]["detail"]["message"] == "no"
    assert rows[1]["ts_nanos"] % 10**9 == 123456789 and rows[4]["nav_to"] == "B" and rows[7]["domain_entity_id"] == "Entity:1"
    write_events(events, str(tmp_path / "out"))
    again, bad = read_events(spark, str(tmp_path / "out"))
    assert bad.count() == 0
    columns = [c for c in events.columns if c != "_ord"]
    a, b = (sorted(map(str, df.select(columns).collect())) for df in (events, again))
    assert a == b


@pytest.mark.parametrize("version,wanted", [(0, "UnsupportedSchemaVersion"), (3, "UnsupportedSchemaVersion"), (-1, "InvalidShape"), ("2", "InvalidShape"), (1.5, "InvalidShape"), (True, "InvalidShape"), (None, "InvalidShape")])
def test_version_gate(spark, tmp_path, version, wanted):
    assert list(classes(spark, tmp_path, [event(0, schema_version=version)]).values()) == [wanted]


def test_shape_rules(spark, tmp_path):
    later = event(0, domain_entity_id="x")
    escaped = later.replace("domain_entity_id", "\\u0064omain_entity_id")
    lines = {
        later: "InvalidShape", escaped: "InvalidShape", json.dumps({"schema_version": 999, "seq": "x"}): "UnsupportedSchemaVersion", '{"schema_version":1,': "Parse", "[1]": "InvalidShape",
        event(0, session_id="nope"): "InvalidShape", event(-1): "InvalidShape", event(0, outcome="maybe"): "InvalidShape", event(0, kind="Other"): "InvalidShape", event(0, ts="yesterday"): "InvalidShape",
        event(0, duration_ms=None): "InvalidShape", event(0, outcome="failure"): "InvalidShape", event(1, args=json.loads("[" * 130 + "]" * 130)): "Parse",
    }
    good = [event(5, extra={"domain_entity_id": 1}), event(6, command_id="domain_entity_id"), event(7) + "\r", "", event(8, version=2, domain_entity_id=None)]
    assert classes(spark, tmp_path, [*lines, *good]) == lines


def test_strict_reading_raises(spark, tmp_path):
    events, _ = read_events(spark, log(tmp_path, [event(0), "{torn"]), strict=True)
    with pytest.raises(Exception, match="Parse"):
        events.count()


def test_session_ids_are_hyphenated(spark, tmp_path):
    events, _ = read_events(spark, log(tmp_path, [event(0, session_id=S1.replace("-", "").upper())]))
    assert events.select("session_id").head()[0] == S1


def test_container_depth():
    assert container_depth('{"a":[1,"[[["]}') == 2 and container_depth('"\\"["') == 0


def test_order_survives_repartition(spark, tmp_path):
    events, _ = read_events(spark, log(tmp_path, [event(i) for i in range(50)]))
    assert [r[0] for r in events.repartition(7).orderBy("_ord").select("seq").collect()] == list(range(50))
    assert events.filter(F.col("seq") == 3).count() == 1
