"""Token-ID output: Parquet list columns, ordered by document, readable by column and by page.

Documents are dealt out by ranges of their id, so file after file holds ascending ids.  Each file
has small row groups with column and offset indexes; token ids are dictionary-encoded, the ascending
columns (document id, start) delta-encoded.  A reader of lengths never touches the ids, and a range
of documents is found by page statistics.

Defined results: null text is empty (its row holds the end id alone); null ids come first; repeated
ids are ordered by a hash of the text, equal rows stay one row each; an empty table gives a folder
without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dfprofile.llm.common import load, pieces, scratch
from dfprofile.llm.tokens import encoder

FILE_SCHEMA = "doc_id long, start_in_file long, n_tokens long, ids array<int>"
MOST_FILES = 100_000  # up to so many, the starts of files are broadcast
PARQUET = {
    "compression": "snappy",
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where no dictionary is wanted
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_file": "false",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode every whole text and write ``path`` in ascending order of ``doc_id``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, start = encoder(tokenizer_path), np.uint32(end_id).tobytes(), 0
        for b in pieces(batches, "text", 8 << 20, 10_000):
            ids = [x + end for x in enc.encode(b.column("text"))]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(start + ends - n), pa.array(n),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                         pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))],
                names=["doc_id", "start_in_file", "n_tokens", "ids"])
            start += int(ends[-1])
        encoder(tokenizer_path).older.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    (rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
     .mapInArrow(encode, FILE_SCHEMA).write.options(**PARQUET).parquet(path))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: the tokens of all files before it (reads the lengths alone)."""
    files = (spark.read.schema(FILE_SCHEMA).parquet(path)
             .groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("n")))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids."""
    return _with_starts(spark, path, _files(spark, path)).select("doc_id", "start", "n_tokens", "ids")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path).select("*", F.col("_metadata.file_name").alias("file"))


def _with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    starts = file_starts(spark, path)
    if len(spark.read.schema(FILE_SCHEMA).parquet(path).inputFiles()) <= MOST_FILES:
        starts = F.broadcast(starts)  # a checked size; else both sides are shuffled
    return rows.join(starts, "file").withColumn("start", F.col("start_in_file") + F.col("file_start"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids in their little-endian 32-bit form."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(), dtype="<i4")).cast("B")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "start_in_file", "n_tokens", "file")),
                 pa.array(crc, pa.int64())],
                names=["doc_id", "start_in_file", "n_tokens", "file", "ids_crc32"])

    rows = _files(spark, path).mapInArrow(
        digest, "doc_id long, start_in_file long, n_tokens long, file string, ids_crc32 long")
    return _with_starts(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def q_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path)
