"""What the operators of this subpackage share: staged tables, guarded broadcasts, and vectorised word hashing.

Text columns travel as Arrow buffers; the helpers here work on those bytes without making Python strings.
White space means the six ASCII characters ``[\\x20\\x09-\\x0D]``, none of which can be part of a multi-byte UTF-8 sequence.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ids (8 bytes each) up to which a set of ids is broadcast; beyond it the same join shuffles.
BROADCAST_IDS = 200_000
#: Bytes of text that a Python worker works on at a time, and bytes of an Arrow batch that it is sent.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
#: Characters that end a word, as a Java and Python character class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master without one a fresh folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send texts to Python in batches of BATCH_BYTES and not of so many rows, which may all be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back."""
    return staged_at(df, fresh_path(df.sparkSession, name))


def staged_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def few(ids: DataFrame, most: int = BROADCAST_IDS) -> bool:
    """Whether ids has at most so many rows; no more than one beyond them are counted."""
    return ids.limit(most + 1).count() <= most


def without_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ids (one distinct column of that name, staged): see only_ids."""
    return rows.join(F.broadcast(ids) if few(ids) else ids, key, "left_anti").select(rows.columns)


def only_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ids (one distinct column of that name): broadcast while the ids are few, else by shuffle."""
    return rows.join(F.broadcast(ids) if few(ids) else ids, key, "left_semi")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string())  # before the chunks are joined, which may exceed 2 GiB
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes each; a longer row makes a range of its own."""
    row, last = 0, len(offsets) - 1
    while row < last:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), last)
        yield row, end
        row = end


_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_HASH_EXACT = np.where(IS_SPACE, np.uint64(0), _BYTE)
_HASH_LOWER = np.where(IS_SPACE, np.uint64(0), _BYTE[LOWER])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """The words of some rows: hash, first byte and end of each; ``row_at[i]:row_at[i + 1]`` are row i's."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row_at: np.ndarray


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row_at) of the words of consecutive rows: see Words."""
    word = ~IS_SPACE[data]
    if not word.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of consecutive rows and a 64-bit hash of each word's bytes (A-Z lower-cased first if asked)."""
    start, end, row_at = word_bounds(data, offsets)
    if len(start) == 0:
        return Words(np.zeros(0, np.uint64), start, end, row_at)
    inside = np.zeros(len(data), np.int64)  # place of a byte after its word's first
    inside[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    longest = int((end - start).max())
    powers = np.cumprod(np.full(longest, _STEP, np.uint64))
    np.minimum(inside, longest - 1, out=inside)
    value = (_HASH_LOWER if lower else _HASH_EXACT)[data]
    value *= powers[inside]
    return Words(mix(np.add.reduceat(value, start)), start, end, row_at)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one row, or of the whole row if it is shorter."""
    if len(words) == 0:
        return words
    width, out = min(width, len(words)), np.uint64(0)
    for k in range(width):
        out = mix(out * np.uint64(0x100000001B3) + words[k : len(words) - width + k + 1] + np.uint64(k + 1))
    return out ^ np.uint64(width)
