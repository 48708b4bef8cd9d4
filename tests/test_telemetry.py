import uuid

from pyspark.sql import functions as F

from pathloom.operators.gates import conservation
from pathloom.sources.telemetry import LAWS, import_window, read_logs, read_selectors, read_spans


def test_import(spark, tmp_path):
    (tmp_path / "trace.csv").write_text("TraceID,SpanID,ParentID,PodName,OperationName,StartTimeUnixNano,EndTimeUnixNano,Duration\nt1,s1,root,web-7f-x,get,2000,5000,1500\nt1,s2,s1,db-1-y,find,x,1,1\nt9,s3,root,db-1-y,find,1,1,1\n")
    (tmp_path / "log.csv").write_text('Timestamp,TimeUnixNano,Node,PodName,Container,TraceID,SpanID,Log\nz,1000,n,web-7f-x,c,t1,s1,"say ""hi"", all"\nz,3000,n,db-1-y,c,t2,s9,a,b\n')
    (tmp_path / "ids.csv").write_text("t1\nt2\nt1\nt3\n")
    alarms = spark.createDataFrame([("db-1-y", 0, "CpuUsageRate(%)")], "pod string, position int, metric_type string")
    ns = uuid.NAMESPACE_URL
    logs = read_logs(spark, str(tmp_path / "log.csv"))
    assert [(r["Log"], r["repaired"]) for r in logs.orderBy("row").collect()] == [('say "hi", all', False), ("a,b", True)]
    got = import_window(read_spans(spark, str(tmp_path / "trace.csv")), logs, read_selectors(spark, str(tmp_path / "ids.csv")), alarms, "ns/rca/w", "1970-01-01 00:00", ns, F.lit(7))
    rows = got.events.orderBy("session_ord", "seq").collect()
    assert [(r["trace_id"], r["seq"], r["command_id"]) for r in rows] == [("t1", 0, "log:7"), ("t1", 1, "span:web get"), ("t2", 0, "alert:CpuUsageRate(%)"), ("t2", 1, "log:7")]
    assert rows[0]["session_id"] == str(uuid.uuid5(ns, "ns/rca/w/t1"))
    counters = {r["name"]: r["value"] for r in got.counters.collect()}
    assert counters["selectors_repeated"] == 1 and counters["log_only_sessions"] == 1 and counters["events_emitted"] == 4
    assert conservation(got.counters, LAWS).count() == 0
    assert [tuple(r) for r in got.rejections.collect()] == [("span:not a number", 1)]
