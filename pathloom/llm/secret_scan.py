"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong patterns (assignments, access keys, long hex) are always reported. Weak ones (identifiers, key-like strings and
endpoints, which alone are mostly harmless) are reported only where complementary parts lie within ``reach`` code points
of each other in one text: a key with an identifier or endpoint, an identifier with a key, an endpoint with both. The
parts of all texts are joined on text and position bucket, so the interval join is an equi-join.

Offsets come from the lengths of the matches and of the pieces between them, as code points with an exclusive end.

Edge cases: null is the empty text, without spans; repeated rows come back as often; null ids stay null; other columns
are ignored; an empty table gives no rows; equal starts are ordered by kind as listed in KINDS; a very long text is scanned
whole, in time that grows with its length and its matches times the root of their number: what overlaps is told by
running values over the sorted parts of a text, and a bucket of positions holds few parts however many the text has.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table


class Kind(NamedTuple):
    name: str
    pattern: str
    #: Group whose length counts, and its least length.
    group: int
    least: int
    #: What the part is in a credential: "id", "key" or "endpoint".
    role: str
    strong: bool
    #: A cheaper pattern without which there is no match.
    hint: str


#: The strong patterns are those of the result's contract.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "key", True, r"(?i)password|passwd|secret|token|api_?key"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, "id", True, r"AKIA"),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32, "key", True, r"[0-9a-f]{32}"),
    Kind("id", r"""(?i)(client_?id|access_?key_?id|account|username|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 4, "id", False, r"(?i)client_?id|access_?key_?id|account|username|login"),
    Kind("key", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", 0, 40, "key", False, r"[A-Za-z0-9+/]{40}"),
    Kind("endpoint", r"(?i)(?<![a-z])(https?|postgres|mysql|redis|amqp|s3)://[A-Za-z0-9._~:@/-]+", 0, 8, "endpoint", False, r"://"),
)
#: Code points between the starts of two parts of one credential.
REACH = 200


def _found(df: DataFrame, kind: Kind) -> DataFrame:
    """Adds array column kind.name of (start, kind number, end) of the matches that are long enough."""
    k, none = kind.name, F.array().cast("array<int>")
    hit = F.col("text").rlike(kind.hint)

    def when_hit(x: Column) -> Column:
        return F.when(hit, x).otherwise(none)

    df = df.withColumns({
        "gaps": when_hit(F.transform(F.split("text", kind.pattern, -1), F.length)),
        "sizes": when_hit(F.transform(F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0)), F.length)),
        "counted": when_hit(F.transform(F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(kind.group)), F.length)) if kind.group else none,
    })
    # Running sums in two levels, in chunks as long as there are chunks: steps[i] is the way from the start of match i - 1
    # to that of match i. A list grows by copying, so a chunk's length bounds what one more match costs.
    steps = F.zip_with("gaps", F.expr("concat(array(0), sizes)"), lambda g, s: g + s)
    df = df.withColumn("steps", F.slice(steps, F.lit(1), F.size("sizes")))
    df = df.withColumn("width", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("steps"))).cast("int")))
    df = df.withColumn("chunks", F.expr("transform(sequence(0, (size(steps) - 1 + width) div width), b -> slice(steps, b * width + 1, width))"))
    df = df.withColumn("ahead", F.expr("aggregate(transform(chunks, c -> aggregate(c, 0, (x, y) -> x + y)), array(0), (all, x) -> concat(all, array(element_at(all, -1) + x)))"))
    grown = "aggregate(c, array(ahead[b]), (all, x) -> concat(all, array(element_at(all, -1) + x)))"
    df = df.withColumn("starts", F.expr(f"flatten(transform(chunks, (c, b) -> slice({grown}, 2, size(c))))"))
    length = "counted[i]" if kind.group else "sizes[i]"
    number = [x.name for x in KINDS].index(k)
    spans = f"transform(starts, (x, i) -> named_struct('start', x, 'kind', {number}, 'end', x + sizes[i], 'ok', {length} >= {kind.least}))"
    return df.withColumn(k, F.expr(f"transform(filter({spans}, s -> s.ok), s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))")).drop("gaps", "sizes", "counted", "steps", "width", "chunks", "ahead", "starts")


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(parts: DataFrame, key: list[str]) -> DataFrame:
    """Strong parts, and those weak ones that overlap none: by the greatest end of the strong parts that start before, and
    the first strong start after, both running values of one text's parts in order."""
    strong = F.col("p.kind") < sum(k.strong for k in KINDS)
    here = Window.partitionBy(*key)
    onward = here.orderBy("p.start", F.when(strong, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    back = here.orderBy(F.desc("p.start"), F.when(strong, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(strong, F.col("p.end"))).over(onward)
    ahead = F.min(F.when(strong, F.col("p.start"))).over(back)
    seen = parts.withColumns({"reach": reach, "ahead": ahead})
    met = F.coalesce(F.col("reach") > F.col("p.start"), F.lit(False)) | F.coalesce(F.col("ahead") < F.col("p.end"), F.lit(False))
    return seen.filter(strong | ~met).drop("reach", "ahead")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, a count for each strong kind, base (strong spans) and spans (all) as kind:start:end, comma-joined."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _found(df, kind)
    strong, weak = [k.name for k in KINDS if k.strong], [k.name for k in KINDS if not k.strong]
    # Rows of equal id and text have equal spans, so that this key may stand for several rows.
    key = ["id_key", "text_key"]
    keys = [F.coalesce("doc_id", F.lit(-1)).alias("id_key"), F.xxhash64("text").alias("text_key")]
    found = staged(df.select("doc_id", *keys, *(F.size(k).cast("long").alias(f"n_{k}") for k in strong), F.concat(*strong).alias("strong"), F.concat(*weak).alias("weak")), "secret-parts")
    roles = F.array(*(F.lit(k.role) for k in KINDS))
    each = found.filter(F.size("weak") > 0).select(*key, F.explode(F.concat("strong", "weak")).alias("p")).distinct()
    parts = staged(_apart(each, key).select(*key, "p", F.get(roles, F.col("p.kind")).alias("role"), F.floor(F.col("p.start") / reach).alias("bucket")), "secret-apart")
    near = parts.select(*key, F.col("p").alias("q"), F.col("role").alias("other"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    weak_part = F.col("p.kind") >= len(strong)
    met = parts.filter(weak_part).join(near, [*key, "bucket"]).filter((F.col("role") != F.col("other")) & (F.abs(F.col("p.start") - F.col("q.start")) <= reach))
    linked = met.groupBy(*key, "p", "role").agg(F.bool_or(F.col("other") == "key").alias("by_key"), F.bool_or(F.col("other") == "id").alias("by_id"), F.bool_or(F.col("other") == "endpoint").alias("by_endpoint"))
    linked = linked.filter(F.when(F.col("role") == "key", F.col("by_id") | F.col("by_endpoint")).when(F.col("role") == "id", F.col("by_key")).otherwise(F.col("by_key") & F.col("by_id")))
    more = linked.groupBy(*key).agg(F.collect_list("p").alias("more"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.join(more, key, "left").select("doc_id", *(f"n_{k}" for k in strong), _written(F.col("strong")).alias("base"), _written(F.concat("strong", F.coalesce("more", none))).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
