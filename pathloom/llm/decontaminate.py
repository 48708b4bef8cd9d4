"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, capitalised names and units become typed placeholders; windows of ``width`` template tokens are hashed and
joined with those of the benchmark; a run of matches along one diagonal is kept only if its slots are consistent, that
is, each value of the item is always the same value in the document. So questions whose numbers and names were changed
are found as well. The same is done with case-folded tokens, where names are literal, so that a passage in capitals, in
lower case or in Title Case is found too. A document and an item are reported when the places found by either form are
``share`` or more of all the item's comparable windows, or of those that the template form can compare.

Windows with fewer literal tokens than half say too little for a form; those that the case-folded form leaves out (mostly
numbers and units) are compared token by token but for case, and items shorter than ``width`` tokens as a whole, so that
every item with a token is searched for. Documents meet each distinct window once, and items only through windows that few
items have (see probes), so that a prompt that many items and many documents share makes no pairs. The benchmark's windows are broadcast while they are few (BROADCAST_WINDOWS
rows), else the join shuffles.

Edge cases: null and empty texts have no tokens and match nothing; an item of one or two words is
found wherever these stand; a very long text is read whole; runs that overlap count each place of the item once; rows that
repeat an id are one document; rows with a null id are left out; other columns are ignored; an empty table
gives no rows; repeated items are reported under each id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only_ids, staged, table

WIDTH, SHARE = 8, (3, 10)
BROADCAST_WINDOWS = 200_000
#: Units of measure and money.
UNITS = "km m cm mm kg g mg lb lbs oz ml l mph kmh km/h percent usd eur dollars euros cents miles meters metres feet inches hours minutes seconds days weeks months years degrees watts volts".split()


#: What separates tokens: every ASCII character but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(text, BETWEEN), lambda t: t != "")


def template(token: Column) -> Column:
    """Tokens that begin with a digit are numbers, those with one capital A-Z before a small letter names; the rest is lower-cased."""
    second = F.substring(token, 2, 1)
    capital = (token >= "A") & (token < "[")
    return F.when(token < ":", "<num>").when(capital, F.when(second != F.upper(second), "<name>").otherwise(F.lower(token))).when(token >= "\u0080", F.lower(token)).when(token.isin(UNITS), "<unit>").otherwise(token)


def caseless(token: Column) -> Column:
    """Capitals, so that letters without a single capital (as a sharp s) are equal too."""
    return F.upper(token)


def folded(token: Column) -> Column:
    """Numbers and units as in the template, in any case; all else is literal whatever its case, names as well."""
    return F.when(token < ":", "<num>").when(F.lower(token).isin(UNITS), "<unit>").otherwise(caseless(token))


FORMS = {"template": template, "folded": folded}


def _prepared(rows: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias(name), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(F.col(name).isNotNull()).select(name, raw_tokens(F.col("text")).alias("raw"))


def window_hashes(rows: DataFrame, width: int, typed: Callable[[Column], Column] = template) -> DataFrame:
    """Adds windows: the hash of each run of ``width`` typed tokens of raw, in order."""
    rows = rows.withColumn("run", F.transform("raw", lambda t: F.xxhash64(typed(t))))
    done, n = 1, F.size("raw")
    # (Those who explode the windows take the outer form: the filter that Spark infers for the other would be evaluated
    # below these projections, where it repeats every pass.)
    while done < width:
        step = min(done, width - done)
        shifted = F.slice("run", F.lit(step + 1), F.greatest(n - step, F.lit(0)))
        rows = rows.withColumn("run", F.zip_with("run", shifted, lambda x, y: F.xxhash64(x, y)))
        done += step
    return rows.withColumn("windows", F.slice("run", F.lit(1), F.greatest(n - (width - 1), F.lit(0)))).drop("run")


def _item_windows(items: DataFrame, width: int, form: str) -> DataFrame:
    """item_id, item_at, hash, form and size of the windows with literals enough."""
    rows = _with_slots(items, width, FORMS[form], FORMS[form])
    return rows.filter(F.col("slots") * 2 <= width).select("item_id", "item_at", "hash", F.lit(form).alias("form"), F.lit(width).alias("size")).distinct()


def _exact_windows(items: DataFrame, width: int) -> DataFrame:
    """The same of the windows that have too few literals even when folded, and of whole items that are shorter."""
    found = _with_slots(items, width, caseless, folded).filter(F.col("slots") * 2 > width).select("item_id", "item_at", "hash", F.lit(width).alias("size"))
    for size in range(1, width):
        short = window_hashes(items.filter(F.size("raw") == size), size, caseless)
        found = found.unionByName(short.select("item_id", F.posexplode("windows").alias("item_at", "hash"), F.lit(size).alias("size")))
    return found.select("item_id", "item_at", "hash", F.lit("exact").alias("form"), "size").distinct()


def _with_slots(items: DataFrame, width: int, typed: Callable[[Column], Column], slotted: Callable[[Column], Column]) -> DataFrame:
    """item_id, item_at and hash of the windows of typed tokens, and how many of their tokens are slots."""
    rows = window_hashes(items, width, typed).select("item_id", F.posexplode("windows").alias("item_at", "hash"), F.transform("raw", lambda t: slotted(t).startswith("<").cast("int")).alias("slot"))
    return rows.withColumn("slots", F.aggregate(F.slice("slot", F.col("item_at") + 1, F.lit(width)), F.lit(0), lambda a, b: a + b))


def _slots(typed: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """The distinct (x, y) values in the slots that x and y share."""
    both = F.zip_with("x", "y", lambda x, y: F.when(typed(x).startswith("<") & (typed(x) == typed(y)), F.struct(value(x).alias("x"), value(y).alias("y"))))
    return F.array_distinct(F.filter(both, lambda s: s.isNotNull()))


def probes(kept: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(form, size, hash, item_id): the windows of each item of which a document must have one to reach the share.

    Of an item's n places, c of which make the share, a document that has c misses at most n - c, so it has one of any
    n - c + 1. These are chosen as the places whose windows the fewest items have: what many items share (a prompt, a
    phrase) alone makes no pairs, unless it makes the share.
    """
    kinds = ["form", "size", "hash"]
    known = kept.groupBy(*kinds).agg(F.count_distinct("item_id").alias("items"))
    places = kept.join(known, kinds).groupBy("item_id", "item_at").agg(F.max("items").alias("items"), F.bool_or(F.col("form") == "template").alias("plain"))

    def enough(*by: str) -> Column:
        whole = Window.partitionBy("item_id", *by)
        n = F.count("*").over(whole)
        needed = F.ceil(n * share[0] / share[1])
        return F.row_number().over(whole.orderBy("items", "item_at")) <= n - needed + 1

    chosen = places.withColumns({"of_all": enough(), "of_plain": enough("plain") & F.col("plain")}).filter("of_all or of_plain")
    return kept.join(chosen.select("item_id", "item_at"), ["item_id", "item_at"], "left_semi").select(*kinds, "item_id").distinct()


def document_hits(told: DataFrame, kept: DataFrame, width: int, sides: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, form, size, hash, at): the places of documents where a window of any item stands; at is null where only
    presence counts. A document's row is there once for each place, however many items have the window. Staged."""
    distinct = kept.select("form", "size", "hash").distinct()
    found = [
        window_hashes(told, width, typed).select("doc_id", F.posexplode_outer("windows").alias("at", "hash"))
        .join(sides(distinct.filter(F.col("form") == form)), "hash").select("doc_id", "form", "size", "hash", "at")
        for form, typed in FORMS.items()
    ]
    # One scan for all sizes of exact windows, of which there are at most ``width``.
    sizes = sorted(r["size"] for r in distinct.filter("form = 'exact'").select("size").distinct().collect())
    if sizes:
        rows = told
        for size in sizes:
            rows = window_hashes(rows, size, caseless).withColumnRenamed("windows", f"windows_{size}")
        exact = rows.select("doc_id", F.explode_outer(F.concat(*map(_sized, sizes))).alias("w")).select("doc_id", "w.size", "w.hash")
        found.append(exact.join(sides(distinct.filter("form = 'exact'")), ["size", "hash"]).select("doc_id", "form", "size", "hash", F.lit(None).cast("int").alias("at")))
    return staged(reduce(DataFrame.unionByName, found), "document-hits")


def _sized(size: int) -> Column:
    return F.transform(F.array_distinct(f"windows_{size}"), lambda h: F.struct(F.lit(size).alias("size"), h.alias("hash")))


def candidates(hits: DataFrame, kept: DataFrame, share: tuple[int, int], sides: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, item_id) of the pairs that have a probe in common. Staged."""
    kinds = ["form", "size", "hash"]
    return staged(hits.select("doc_id", *kinds).join(sides(probes(kept, share)), kinds).select("doc_id", "item_id").distinct(), "candidates")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, item_id, n_windows (of the item's, found), item_windows (of the item's, comparable), verbatim (all slots equal but for case)."""
    items = _prepared(benchmark, item_col, item_text, "item_id")
    kept = staged(reduce(DataFrame.unionByName, [*(_item_windows(items, width, form) for form in FORMS), _exact_windows(items, width)]), "item-windows")
    few = kept.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    told = _prepared(docs, id_col, text_col, "doc_id")

    def sides(rows: DataFrame) -> DataFrame:
        """Rows made of item windows, no more than these."""
        return F.broadcast(rows) if few else rows

    doc_hits = document_hits(told, kept, width, sides)
    pairs = candidates(doc_hits, kept, share, sides).join(sides(kept), "item_id")
    hits = staged(pairs.join(doc_hits, ["doc_id", "form", "size", "hash"]).select("doc_id", "item_id", "form", "item_at", "at").distinct(), "hits")
    moved = hits.filter("at is not null").withColumn("shift", F.col("at") - F.col("item_at"))
    runs = staged(moved.groupBy("doc_id", "item_id", "form", "shift").agg(F.min("item_at").alias("first"), F.max("item_at").alias("last"), F.sort_array(F.collect_set("item_at")).alias("places")), "template-runs")
    # Slots of each run: values of the item beside those of the document. An id that repeats with several texts has several rows.
    texts = only_ids(told, runs.select("doc_id").distinct(), "doc_id").select("doc_id", F.col("raw").alias("doc_raw"))
    both = runs.join(texts, "doc_id").join(items.withColumnRenamed("raw", "item_raw"), "item_id")
    span = F.col("last") - F.col("first") + width
    both = both.filter(F.col("first") + F.col("shift") + span <= F.size("doc_raw")).select("doc_id", "item_id", "form", "places", F.slice("item_raw", F.col("first") + 1, span).alias("x"), F.slice("doc_raw", F.col("first") + F.col("shift") + 1, span).alias("y"))
    both = both.withColumn("slots", F.when(F.col("form") == "folded", _slots(folded, caseless)).otherwise(_slots(template, lambda t: t)))
    both = both.filter(F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["x"]))))
    both = both.select("doc_id", "item_id", "places", F.forall("slots", lambda s: caseless(s["x"]) == caseless(s["y"])).alias("verbatim"))
    # Exact windows have no slots to compare, so that their places alone tell.
    exact = hits.filter("at is null").groupBy("doc_id", "item_id").agg(F.collect_set("item_at").alias("places"))
    both = both.unionByName(exact.withColumn("verbatim", F.lit(True)))
    found = both.groupBy("doc_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.bool_and("verbatim").alias("verbatim"))
    sizes = kept.groupBy("item_id").agg(F.countDistinct("item_at").alias("item_windows"), F.collect_set(F.when(F.col("form") == "template", F.col("item_at"))).alias("plain"))
    found = found.join(sizes, "item_id").withColumn("n_windows", F.size("places").cast("long"))
    of_all = F.col("n_windows") * share[1] >= F.col("item_windows") * share[0]
    of_plain = (F.size("plain") > 0) & (F.size(F.array_intersect("places", "plain")) * share[1] >= F.size("plain") * share[0])
    return found.filter(of_all | of_plain).select("doc_id", "item_id", "n_windows", "item_windows", "verbatim")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
