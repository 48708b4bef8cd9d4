"""Event logs as JSON Lines (plain, .gz or .zst): validation, upcasting, an error table, and writing.

A line is one envelope: schema_version (1 or 2), the common fields, kind and the kind's fields. Version errors are found before
shape errors; a field of a later version than the line's is a shape error; unknown fields are fine. Version 1 becomes
version 2 with no entity. Lines end with a line feed; a carriage return before it and blank lines are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from .scratch import staged

CURRENT, DEEPEST = 2, 127
#: Fields by the version that brought them.
LATER_FIELDS = {2: ["domain_entity_id"]}
TEXT, COUNT, POLICY, ANY = "text", "count", "policy", "any"
#: Each kind's fields (name in the log, column, type, required).
KINDS: dict[str, list[tuple[str, str, str, bool]]] = {
    "ScreenOpened": [("screen_id", "screen_id", TEXT, True), ("params", "params", ANY, False)],
    "CommandExecuted": [("command_id", "command_id", TEXT, True), ("args", "args", ANY, False), ("duration_ms", "duration_ms", COUNT, True), ("outcome", "outcome", "outcome", True)],
    "FieldChanged": [("field_id", "field_id", TEXT, True), ("old", "old", POLICY, True), ("new", "new", POLICY, True)],
    "ExceptionThrown": [("exception_type", "exception_type", TEXT, True), ("message", "message", TEXT, True), ("stack", "stack", TEXT, False)],
    "NavigationOccurred": [("from", "nav_from", TEXT, True), ("to", "nav_to", TEXT, True)],
    "ValidationFailed": [("validator", "validator", TEXT, True), ("field_id", "field_id", TEXT, True), ("reason", "reason", TEXT, True)],
    "AsyncOperationCompleted": [("operation_id", "operation_id", TEXT, True), ("duration_ms", "duration_ms", COUNT, True), ("outcome", "outcome", "outcome", True)],
}
OUTCOMES = ("success", "failure", "cancelled", "timed_out")
POLICIES = {"raw": "value", "masked": "display", "bucketed": "bucket", "hashed": "hash", "removed": None}
POLICY_TYPE = "struct<policy:string,value:string,display:string,bucket:string,hash:string,algo:string>"
UUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\z"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"


def container_depth(text: str) -> int:
    """Greatest nesting of arrays and objects of a JSON text, by its brackets outside strings."""
    depth = most = 0
    quoted = skip = False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            quoted, skip = c != '"', c == "\\"
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


def too_deep(line: Column) -> Column:
    """Nested deeper than the limit. Only lines with enough opening brackets are counted out in Python."""

    @F.pandas_udf("int")
    def depth(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else container_depth(t))

    brackets = F.length(line) - F.length(F.translate(line, "[{", ""))
    return F.coalesce(depth(F.when(brackets > DEEPEST, line)) > DEEPEST, F.lit(False))


def _fields() -> dict[str, str]:
    """Every field of the log by name, with its type; policies are taken apart."""
    out = {"schema_version": COUNT, "seq": COUNT, "session_id": TEXT, "ts": TEXT, "correlation_id": TEXT, "domain_entity_id": TEXT, "kind": TEXT, "detail.message": TEXT}
    for fields in KINDS.values():
        for name, _, t, _ in fields:
            if t == POLICY:
                out |= {f"{name}.policy": TEXT, f"{name}.value": ANY, **{f"{name}.{x}": TEXT for x in ("display", "bucket", "hash", "algo")}}
            else:
                out[name] = TEXT if t == "outcome" else t
    return out


def _json_type(v: Column) -> Column:
    """text, whole, other, or null if the field is absent or null."""
    t = F.schema_of_variant(v)
    return F.when(t == "STRING", "text").when(t == "BIGINT", "whole").when(t != "VOID", "other")


def _x(field: str) -> Column:
    return F.col("x").getField(field.replace(".", "_"))


def _t(field: str) -> Column:
    return F.col("t").getField(field.replace(".", "_"))


def _text_bad(field: str, required: bool) -> Column:
    return F.when(_t(field).isNull(), F.lit(required)).otherwise(_t(field) != "text")


def _field_bad(name: str, kind: str, required: bool) -> Column:
    if kind == ANY:
        return F.lit(False)
    if kind == TEXT:
        return _text_bad(name, required)
    if kind == COUNT:
        return ~F.coalesce((_t(name) == "whole") & (_x(name) >= 0), F.lit(False))
    if kind == "outcome":
        return ~F.coalesce((_t(name) == "text") & _x(name).isin(*OUTCOMES), F.lit(False)) | F.coalesce((_x(name) == "failure") & (F.coalesce(_t("detail.message"), F.lit("none")) != "text"), F.lit(False))
    policy = _x(f"{name}.policy")
    lacks = F.lit(False)
    for label, part in POLICIES.items():
        if part and label != "raw":
            lacks = lacks | ((policy == label) & (F.coalesce(_t(f"{name}.{part}"), F.lit("none")) != "text"))
    return ~F.coalesce(policy.isin(*POLICIES), F.lit(False)) | F.coalesce(lacks, F.lit(False))


def _value(name: str, kind: str) -> Column:
    if kind == POLICY:
        return F.struct(*(_x(f"{name}.{p}").alias(p) for p in ("policy", "value", "display", "bucket", "hash", "algo")))
    return _x(name)


def hyphenated(u: Column) -> Column:
    h = F.lower(F.replace(u, F.lit("-"), F.lit("")))
    return F.when(u.isNotNull(), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds to lines (value and any others): all event columns and error_class, null on good lines."""
    text = F.regexp_replace("value", r"\r\z", "")
    df = lines.withColumn("raw", text).filter(F.trim("raw") != "").withColumn("v", F.try_parse_json("raw"))
    # Fields are taken out once, as two structs: values (x) and JSON types (t).
    parts = {n: F.try_variant_get("v", f"$.{n}", "variant") for n in _fields()}
    kinds = {TEXT: "string", COUNT: "bigint"}
    values = [(F.to_json(v) if t == ANY else F.try_variant_get("v", f"$.{n}", kinds[t])).alias(n.replace(".", "_")) for (n, t), v in zip(_fields().items(), parts.values())]
    df = df.withColumns({"x": F.struct(*values), "t": F.struct(*(_json_type(v).alias(n.replace(".", "_")) for n, v in parts.items()))})
    version, whole = _x("schema_version"), F.coalesce(_t("schema_version") == "whole", F.lit(False))
    later = F.lit(False)
    for since, names in LATER_FIELDS.items():
        for n in names:
            later = later | (F.coalesce(F.array_contains(F.json_object_keys("raw"), n), F.lit(False)) & (version < since))
    shape = F.lit(True)
    for k, fields in KINDS.items():
        bad = F.lit(False)
        for name, _, t, required in fields:
            bad = bad | _field_bad(name, t, required)
        shape = F.when(_x("kind") == k, bad).otherwise(shape)
    common = ~F.coalesce((_t("seq") == "whole") & (_x("seq") >= 0), F.lit(False)) | ~F.coalesce((_t("session_id") == "text") & _x("session_id").rlike(UUID), F.lit(False)) | ~F.coalesce((_t("ts") == "text") & _x("ts").rlike(RFC3339), F.lit(False))
    common = common | F.coalesce((_t("correlation_id") != "text") | ~_x("correlation_id").rlike(UUID), F.lit(False)) | _text_bad("domain_entity_id", False)
    broken = F.col("v").isNull() | too_deep(F.col("raw"))
    not_object = ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    moment = F.try_to_timestamp(F.regexp_replace(F.upper(_x("ts")), " ", "T"))
    wrong = (
        F.when(~F.is_valid_utf8(F.col("raw")), "Io").when(broken, "Parse").when(not_object | ~whole | (version < 0), "InvalidShape")
        .when(~version.between(1, CURRENT), "UnsupportedSchemaVersion").when(later | common | shape | moment.isNull(), "InvalidShape")
    )
    df = df.withColumn("error_class", wrong)
    fraction = F.rpad(F.substring(F.regexp_extract(_x("ts"), r"\.([0-9]+)", 1), 1, 9), 9, "0")
    columns = {
        "schema_version": F.lit(CURRENT), "session_id": hyphenated(_x("session_id")), "seq": _x("seq"), "ts": moment,
        "ts_nanos": F.unix_seconds(moment) * 1_000_000_000 + fraction.cast("bigint"), "correlation_id": hyphenated(_x("correlation_id")), "domain_entity_id": _x("domain_entity_id"), "kind": _x("kind"),
    }
    for k, fields in KINDS.items():
        for name, column, t, _ in fields:
            value = F.when(_x("kind") == k, _value(name, t))
            columns[column] = F.coalesce(columns[column], value) if column in columns else value
    columns["detail"] = F.when(_x("kind").isin("CommandExecuted", "AsyncOperationCompleted") & (_x("outcome") == "failure"), F.struct(_x("detail.message").alias("message")))
    return df.withColumns(columns).drop("v", "x", "t")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, _ord): the lines and their place: file, block and position."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos")).alias("_ord"))


def read_events(spark: SparkSession, path: str | list[str], strict: bool = False, stage: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, errors): good lines as events; the rest as (_ord, raw, error_class). strict: reading a bad line raises.
    stage: lines are parsed once, into a staged table of both, for those who read events and errors or either twice."""
    parsed = parse_lines(read_lines(spark, path))
    if stage:
        parsed = staged(parsed.withColumns({"value": F.lit(None).cast("string"), "raw": F.when(F.col("error_class").isNotNull(), F.col("raw"))}), "parsed-lines")
    if strict:
        stop = F.when(F.col("error_class").isNotNull(), F.raise_error(F.concat(F.col("error_class"), F.lit(": "), F.substring("raw", 1, 200))).cast("string"))
        parsed = parsed.withColumn("error_class", stop)
    return parsed.filter("error_class is null").drop("value", "raw", "error_class"), parsed.filter("error_class is not null").select("_ord", "raw", "error_class")


def envelope(events: DataFrame) -> Column:
    """The JSON line of an event; absent fields are left out."""
    have = set(events.columns)

    def col(c: str, cast: str = "string") -> Column:
        return F.col(c) if c in have else F.lit(None).cast(cast)

    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.pmod(F.col("ts_nanos"), F.lit(1_000_000_000)) if "ts_nanos" in have else F.pmod(F.unix_micros("ts"), F.lit(1_000_000)) * 1000).cast("string"), 9, "0"), F.lit("Z"))
    fields = [F.lit(CURRENT).alias("schema_version"), F.col("seq"), F.col("session_id"), stamp.alias("ts"), col("correlation_id").alias("correlation_id"), col("domain_entity_id").alias("domain_entity_id"), F.col("kind")]
    done: set[str] = set()
    for kind_fields in KINDS.values():
        for name, column, t, _ in kind_fields:
            if name in done:
                continue
            done.add(name)
            if t == ANY:
                fields.append(F.parse_json(col(column)).alias(name))
            elif t == POLICY:
                p = col(column, POLICY_TYPE)
                fields.append(F.when(p.isNotNull(), F.struct(p["policy"].alias("policy"), F.parse_json(p["value"]).alias("value"), *(p[x].alias(x) for x in ("display", "bucket", "hash", "algo")))).alias(name))
            else:
                fields.append(col(column, "bigint" if t == COUNT else "string").alias(name))
    message = F.col("detail.message") if "detail" in have else F.lit(None).cast("string")
    fields.append(F.when(F.col("outcome") == "failure", F.struct(F.coalesce(message, F.lit("")).alias("message"))).alias("detail"))
    return F.to_json(F.struct(*fields))


def write_events(events: DataFrame, path: str, mode: str = "append", compression: str | None = None) -> None:
    """Appends the events as JSON lines; events nested too deeply raise."""
    line = envelope(events)
    checked = F.when(too_deep(line), F.raise_error(F.lit("nested too deeply")).cast("string")).otherwise(line)
    writer = events.select(checked.alias("value")).write.mode(mode)
    (writer.option("compression", compression) if compression else writer).text(path)


def upcast(events: DataFrame, version: int, steps: dict[int, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Runs the steps from version to the current one; step n turns version n into n + 1."""
    for n in range(version, CURRENT):
        events = (steps or UPCASTERS)[n](events)
    return events


UPCASTERS: dict[int, Callable[[DataFrame], DataFrame]] = {1: lambda df: df.withColumn("domain_entity_id", F.lit(None).cast("string")).withColumn("schema_version", F.lit(2))}


def version() -> dict[str, str | int]:
    return {"pathloom": "0.1.0", "schema": CURRENT}


def dumps(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
