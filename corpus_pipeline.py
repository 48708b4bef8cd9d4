"""A training-data pipeline: quality, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last keep the columns of documents. Quality, personal data and tokens look at each row by itself, so the
verdict stays with the row; near-duplicates and leaks are found by a row key that no two rows share (doc_id, where that
is unique). A key set is broadcast while it is small (llm.common.BROADCAST_IDS), else the join shuffles.

Edge cases of every stage: a row with a null id, or an id that other rows have too, is judged by its own text like any
other row; a null text is the empty one, which the quality stage judges like any other and which is no duplicate, holds no
item and has no personal data (it stays null) and no tokens; nulls in the other columns stay; exact copies under one id are
duplicates, of which one stays; very long texts are worked on whole; an empty table gives no rows; further columns of the
documents, whatever their names, are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bpe import default_tokenizer, encode_texts
from pathloom.llm.common import few, staged, table, without_ids
from pathloom.llm.decontaminate import contaminated
from pathloom.llm.near_dedup import near_duplicates
from pathloom.llm.pii import personal_data
from pathloom.llm.quality_classifier import classify

KEY = "pipeline_row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY: doc_id where no other row has it, else a number above all ids (which are below 2 ** 62)."""
    own = F.col("doc_id").cast("long")
    odd = staged(docs.groupBy(own.alias("odd")).agg(F.count("*").alias("rows")).filter("odd is null or rows > 1").select("odd"), "odd-ids")
    if not odd.head(1):
        return docs.withColumn(KEY, own)
    met = odd.filter("odd is not null")
    met = F.broadcast(met) if few(met) else met
    rest = docs.join(met, own == F.col("odd"), "left_anti").filter(own.isNotNull())
    some = docs.join(met, own == F.col("odd"), "left_semi").unionByName(docs.filter(own.isNull()))
    top = docs.agg(F.coalesce(F.max(own), F.lit(0)).alias("top")).head()["top"]
    return rest.withColumn(KEY, own).unionByName(staged(some.withColumn(KEY, F.lit(top + 1) + F.monotonically_increasing_id()), "odd-rows"))


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not in keys (column doc_id), without the key."""
    gone = staged(keys.select(F.col("doc_id").alias(KEY)).distinct(), "rejected")
    return without_ids(rows, gone, KEY).drop(KEY)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rest = [c for c in docs.columns if c != "text"]
    return classify(docs, carry=rest).filter("kept").select(*("text" if c == "text" else F.col(f"carried.`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays (rows of an odd id come after the others)."""
    rows = keyed(docs)
    return _without(rows, near_duplicates(rows, id_col=KEY).filter("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = keyed(docs)
    return _without(rows, contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=KEY))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars, where there is one, follows."""
    rest = [c for c in docs.columns if c != "text"]
    clean = personal_data(docs, redacted=True, carry=rest)
    text = F.when(F.col("spans") == "", F.col("original")).otherwise(F.col("redacted"))
    columns = {c: F.col(f"carried.`{c}`") for c in rest} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return clean.select(*(columns[c].alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of each document left."""
    return encode_texts(docs, default_tokenizer())


STAGES = [("quality_classifier", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", redact), ("bpe", encode)]
#: No stage's models and groups can be told in SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
