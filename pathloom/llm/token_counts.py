"""Token counts of documents in flat token files, by a separator scan.

A token file is an unindexed run of little-endian unsigned 16-bit ids in which each document ends with the separator.
Blocks of a file are planned from its size alone and searched for separators with vectorised comparisons; a block reports
how many separators it has and the lengths of the stretches between them. A prefix scan over the blocks' separator counts
then gives each stretch the ordinal of its document in the file, and the two parts of a document that a block edge
cuts meet under one ordinal.

Edge cases: null and empty texts are documents of no tokens; a separator written out in a text is encoded as plain text;
repeated rows are counted each; null ids stay null; other columns are ignored; an empty table or file gives no rows; a file
without a last separator ends with an unfinished document, which counts as one if it has tokens; a very long document
spans blocks; a tokenizer with ids beyond 16 bits raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Shared, default_tokenizer, encoded_slices, encoder_of
from .common import fresh_path, staged, table
from .storage import filesystem

SEPARATOR, BLOCK_TOKENS, BLOCKS_A_TASK, TOP_ID = 49407, 4 << 20, 4, 65535


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a file for each partition; returns (file, ordinal, doc_id), staged, of the files that count.

    A task that is run again writes a file of another name; only files named in the result belong to the corpus.
    """
    shared = Shared(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (system, root) = encoder_of(shared), filesystem(folder)
        system.create_dir(root, recursive=True)
        name, ordinal, out = f"tokens-{uuid.uuid4().hex}.bin", 0, None
        if max(len(encoder.labels) - 1, separator) > TOP_ID:
            raise ValueError(f"ids beyond {TOP_ID} do not fit into a token file")
        for batch in batches:
            if out is None and batch.num_rows:
                out = system.open_output_stream(f"{root}/{name}")
            for _, ids, at in encoded_slices([batch], encoder, special=False):
                out.write(np.insert(ids, at[1:], separator).astype("<u2").tobytes())
            yield pa.record_batch([pa.array([name] * batch.num_rows, pa.string()), pa.array(np.arange(ordinal, ordinal + batch.num_rows)), batch.column(0)], names=["file", "ordinal", "doc_id"])
            ordinal += batch.num_rows
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-files")


def plan_blocks(spark: SparkSession, folder: str, files: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, first, tokens): blocks of the files (column file), planned from their sizes on the executors.

    The plan is staged and dealt out by block, so that however few the files, every BLOCKS_A_TASK blocks are a task.
    """

    def run(batches):
        system, root = filesystem(folder)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                total = system.get_file_info(f"{root}/{name}").size // 2
                rows += [(name, k, at, min(block_tokens, total - at)) for k, at in enumerate(range(0, total, block_tokens))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["file", "block", "first", "tokens"])

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    planned = staged(files.select("file").distinct().mapInArrow(run, "file string, block long, first long, tokens long"), "token-blocks")
    return planned.repartition(max(1, -(-planned.count() // BLOCKS_A_TASK)), "file", "block")


def scan_blocks(blocks: DataFrame, folder: str, separator: int = SEPARATOR) -> DataFrame:
    """(file, block, separators, lengths): lengths of the stretches that the separators cut the block into, in order."""

    def run(batches):
        system, root = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    ids = np.frombuffer(source.read_at(row["tokens"] * 2, row["first"] * 2), "<u2")
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
                yield pa.record_batch([pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], names=["file", "block", "separators", "lengths"])

    return blocks.mapInArrow(run, "file string, block long, separators long, lengths array<bigint>")


def document_lengths(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) by an exclusive prefix sum of separators over each file's blocks."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = scanned.withColumn("skipped", F.coalesce(F.sum("separators").over(before), F.lit(0)))
    parts = placed.select("file", "skipped", "separators", F.posexplode("lengths").alias("at", "n"))
    whole = parts.groupBy("file", (F.col("skipped") + F.col("at")).alias("ordinal")).agg(F.sum("n").alias("n_tokens"), F.max((F.col("at") < F.col("separators")).cast("int")).alias("ended"))
    return whole.filter("ended = 1 or n_tokens > 0").select("file", "ordinal", "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, folder: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """doc_id and n_tokens of every row of docs, counted in the token files written for them."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    named = write_token_files(docs, folder, tokenizer, separator, id_col=id_col, text_col=text_col)
    blocks = plan_blocks(spark, folder, named, block_tokens)
    counted = document_lengths(staged(scan_blocks(blocks, folder, separator), "blocks"))
    return named.join(counted, ["file", "ordinal"], "left").select("doc_id", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_tokenizer())
