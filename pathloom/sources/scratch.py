"""Fresh paths, and staged tables, in the folder that driver and executors share."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A path under spark.checkpoint.dir; without that setting a local master gets a folder of its own, any other raises."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        shared = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back, so that what follows does not compute them again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that must be small; more than ``most`` of them raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows
