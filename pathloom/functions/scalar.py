"""Scalar functions over event columns. All are Catalyst expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1


def _add(a: int, b: int) -> int:
    return min(LONG_MAX, a + b)


def bucket_label(value: Column, bounds: tuple[int, ...]) -> Column:
    """The bucket of a BIGINT: the single number, 'low-high', or 'last+'; negative values mirror with a leading '-'."""
    size = F.when(value < 0, F.when(value == -LONG_MAX - 1, F.lit(LONG_MAX)).otherwise(-value)).otherwise(value)
    label, low = None, 0
    for bound in bounds:
        name = str(bound) if low == bound else f"{low}-{bound}"
        label = F.when(size <= bound, name) if label is None else label.when(size <= bound, name)
        low = _add(bound, 1)
    above = f"{_add(bounds[-1] if bounds else 0, 1)}+"
    label = F.lit(above) if label is None else label.otherwise(above)
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), label))


def is_email(s: Column) -> Column:
    return s.rlike(r"(?s)^[^@]+@[^.].*\.")


def is_guid(s: Column) -> Column:
    return s.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z")


def string_class(s: Column) -> Column:
    return F.when(is_email(s), "email").when(is_guid(s), "guid").when(s.rlike(r"^[0-9]+\z"), "numeric").when(s.isNotNull(), "free")


def length_bucket(s: Column) -> Column:
    n = F.octet_length(s)
    return F.when(n == 0, "0").when(n <= 8, "1-8").when(n <= 32, "9-32").when(n <= 128, "33-128").when(n.isNotNull(), "128+")


def ms_between(later: Column, earlier: Column) -> Column:
    """Whole milliseconds, cut toward zero."""
    return F.call_function("div", F.unix_micros(later) - F.unix_micros(earlier), F.lit(1000))


def rounded_rate(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole rounded half away from zero; 0.0 for an empty whole."""
    scale = 10**digits
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part / whole * scale + 0.5) / scale)


def is_error() -> Column:
    return F.col("kind").isin("ExceptionThrown", "ValidationFailed") | F.coalesce(F.col("outcome") != "success", F.lit(False))


def event_label() -> Column:
    """Kind:identifier, with both ends of a navigation and validator and field of a validation."""
    k = F.col("kind")
    return F.concat(k, F.lit(":"), (
        F.when(k == "ScreenOpened", F.col("screen_id")).when(k == "CommandExecuted", F.col("command_id")).when(k == "FieldChanged", F.col("field_id"))
        .when(k == "ExceptionThrown", F.col("exception_type")).when(k == "NavigationOccurred", F.concat_ws("→", "nav_from", "nav_to"))
        .when(k == "ValidationFailed", F.concat_ws(":", "validator", "field_id")).when(k == "AsyncOperationCompleted", F.col("operation_id"))
    ))


def index_columns() -> dict[str, Column]:
    """The columns that slices look at: an operation counts as a command, only opened screens as screens."""
    return {"idx_kind": F.col("kind"), "idx_command_id": F.coalesce("command_id", "operation_id"), "idx_screen_id": F.when(F.col("kind") == "ScreenOpened", F.col("screen_id")), "idx_outcome": F.col("outcome")}


def service_of(pod: Column) -> Column:
    """The pod's name without its last two dash-separated parts, as far as it has them."""
    for _ in range(2):
        pod = F.regexp_replace(pod, r"-[^-]*$", "")
    return pod


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The name-based UUID of version 5 in lower-case hyphenated form."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def rfc3339_nanos(nanos: Column) -> Column:
    whole = F.floor(nanos / 1_000_000_000).cast("bigint")
    return F.concat(F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(nanos, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


def abnormal_window(inject_time: Column) -> Column:
    """'YYYY-MM-DD HH:MM' two minutes after 'YYYY-MM-DD HH:MM...'; the hour rolls over at 60 but the day does not."""
    hour, minute = F.substring(inject_time, 12, 2).cast("int"), F.substring(inject_time, 15, 2).cast("int") + 2
    hour = hour + F.when(minute >= 60, 1).otherwise(0)
    return F.concat(F.substring(inject_time, 1, 10), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(minute, F.lit(60)).cast("string"), 2, "0"))


def over_threshold(metric: Column, value: Column, network_limit: Column) -> Column:
    """Alarm rule: processor and memory rates over 80 percent, the latency percentile over the system's limit."""
    return F.when(metric.rlike("(?i)cpu|memory"), value > 80).when(metric.startswith("NetworkP90"), value > network_limit).otherwise(False)


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def policy(kind: str, payload: Column | None = None, algo: str | None = None) -> Column:
    """A value policy struct: raw, masked, bucketed, hashed or removed."""
    names = {"raw": "value", "masked": "display", "bucketed": "bucket", "hashed": "hash"}
    empty = F.lit(None).cast("string")
    fields = {n: payload.cast("string") if names.get(kind) == n and payload is not None else empty for n in ("value", "display", "bucket", "hash")}
    return F.struct(F.lit(kind).alias("policy"), *(c.alias(n) for n, c in fields.items()), F.lit(algo).cast("string").alias("algo"))
