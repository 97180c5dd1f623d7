"""Shared helpers: scratch tables in the cluster's shared folder, names, text as bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where that is unset and the
    master is one process (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder (column-wise, compressed)."""
    path = scratch(df.sparkSession, tag)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stash that no later read needs."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder; Spark's cleaner removes its files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(col: str | Column = "text") -> Column:
    """UTF-8 bytes of the text; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit("")).cast("binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20,
           max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the incoming batches: about ``max_bytes`` of ``column`` (one row at
    least), so that what a task holds does not follow the batch size."""
    for b in batches:
        n, lo, size = b.num_rows, 0, 0
        lengths = pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False)
        for i in range(n):
            x = lengths[i]
            x = 0 if x != x else x
            if i > lo and (size + x > max_bytes or i - lo >= max_rows):
                yield b.slice(lo, i - lo)
                lo, size = i, 0
            size += x
        if n > lo:
            yield b.slice(lo)
    give_back()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


MOST_BROADCAST = 1_000_000


def checked(keys: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Checkpoint a narrow table and mark it for broadcast if it has ``most`` rows or fewer; a
    larger one is left to a shuffled join."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= most else keys
