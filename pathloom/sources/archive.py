"""The Parquet archive: ingests that are only ever added, partitioned by ingest and by the UTC day on which a session starts.

An ingest never rewrites what others wrote, so a lost job leaves the archive as it was. Reading resolves the ingests: of the
events with one session and sequence number that of the newest ingest counts, and a session's day is that of its first
event in all ingests. An archive of one ingest is read as it lies; ``compacted`` writes one ingest anew from several.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_archive(events: DataFrame, path: str, compression: str = "zstd", row_group_bytes: int | None = None) -> None:
    """Add an ingest. One shuffle by session serves the day, the order and the files.

    events have one row for each session and sequence number (summary.last_write_wins).
    """
    start = F.min("ts").over(Window.partitionBy("session_id"))
    dated = events.withColumn("dt", F.to_date(start)).withColumn("ingest", F.lit(time.time_ns()))
    writer = dated.sortWithinPartitions("dt", "session_id", "seq").write.mode("append").option("compression", compression)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.partitionBy("ingest", "dt").parquet(path)


def ingests(spark: SparkSession, path: str) -> list[int]:
    """The numbers of an archive's ingests, oldest first; bounded by how often the archive was written."""
    return sorted(r["ingest"] for r in spark.read.parquet(path).select("ingest").distinct().collect())


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every event, with dt, the day of its session."""
    rows = spark.read.parquet(path)
    if len(ingests(spark, path)) <= 1:
        return rows.drop("ingest")
    # Both windows use the one partitioning by session.
    newest = Window.partitionBy("session_id", "seq").orderBy(F.desc("ingest"))
    kept = rows.repartition("session_id").withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "ingest")
    return kept.withColumn("dt", F.to_date(F.min("ts").over(Window.partitionBy("session_id"))))


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """Write the archive's newest versions as the one ingest of a new archive."""
    write_archive(read_archive(spark, path).drop("dt"), to)
