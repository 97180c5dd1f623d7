"""Packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``size`` tokens.  The histogram of piece lengths has at most
``size`` bins, whatever the corpus, so the driver places bins, not pieces: longest lengths first,
always onto the least filled packs.  Packs with the same pattern of lengths are one run of sequence
ids; placing a length on part of a run splits it.  The placements (length, ranks, sequence run,
offset) are then joined back to the pieces by length and rank.

Each length adds at most three runs and every placement fills a run by a token at least, so the
placement table is bounded by ``size`` alone; it is broadcast under that bound.

Defined results: null text is empty (the end id alone); repeated rows are packed once each; an empty
table gives no rows; other columns are ignored.  Equal rows may swap places, nothing else is open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dfprofile.llm.common import fresh, give_back, load, pieces, stash
from dfprofile.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2,
                 with_ids: bool = False, forget: bool = False) -> DataFrame:
    """Every document's ids plus ``end_id``, cut into pieces of at most ``size`` ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forget:
            give_back()  # what earlier stages have freed, before the vocabulary comes
        enc, end = encoder(tokenizer_path), np.uint32(end_id).tobytes()
        for b in pieces(batches, "text", (2 if forget else 8) << 20, 10_000):
            rows: list[tuple] = []
            ids = enc.encode(b.column("text"))
            for doc, x in zip(b.column("doc_id").to_pylist(), ids):
                x += end
                for i in range(0, len(x), 4 * size):
                    part = x[i:i + 4 * size]
                    rows.append((doc, i // 4, len(part) // 4, zlib.crc32(part), len(x) // 4,
                                 np.frombuffer(part, dtype=np.int32) if with_ids else None))
            cols = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]]
            if with_ids:
                cols.append(pa.array([r[5] for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])
        enc.older.clear()
        if forget:
            enc.pieces.clear()
            give_back()

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, schema)


def plan_packs(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, rank behind the last, first sequence, copies per sequence,
    offset) for a histogram length -> count."""
    open_runs: list[tuple[int, int, int]] = []  # fill, first sequence, sequences
    out, fresh_seq = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if open_runs and open_runs[0][0] + length <= size:
                fill, first, n = heappop(open_runs)
                per = (size - fill) // length
                if open_runs:  # until it is no longer the shortest
                    per = min(per, max(1, -(-(open_runs[0][0] - fill) // length)))
                if left < n:
                    heappush(open_runs, (fill, first + left, n - left))
                    n, per = left, 1
                per = min(per, left // n)
            else:  # a new pack stays the shortest until it is full
                fill, first, per = 0, fresh_seq, min(size // length, left)
                n = left // per
                fresh_seq += n
            out.append((length, rank, rank + n * per, first, per, fill))
            if fill + per * length < size:
                heappush(open_runs, (fill + per * length, first, n))
            rank, left = rank + n * per, left - n * per
    return out


def pack(parts: DataFrame, size: int = 4096, salts: int = 256) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``size`` and the order
    columns ``doc_id`` and ``start``.  ``parts`` must give the same rows each time (a stash).

    Ranks within a length are counted per salt first, so a length that holds a third of all pieces
    is numbered by ``salts`` tasks or more."""
    spark = parts.sparkSession
    salt, before, rank, lo, hi, first, per, at, key = fresh(
        parts, "salt", "before", "rank", "lo", "hi", "first", "per", "at", "len")
    salted = parts.withColumn(salt, F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    places = spark.createDataFrame(plan_packs(histogram, size) or [(0, 0, 0, 0, 1, 0)],
                                   f"{key} long, {lo} long, {hi} long, {first} long, {per} long, {at} long")
    up = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", salt, F.coalesce(F.sum("n").over(up), F.lit(0)).alias(before))
    order = Window.partitionBy("length", salt).orderBy(
        F.col("doc_id").asc_nulls_first(), "start", *[c for c in ("ids_crc32",) if c in parts.columns])
    ranked = (salted.withColumn(rank, F.row_number().over(order) - 1)
              .join(firsts, ["length", salt])
              .withColumn(rank, F.col(rank) + F.col(before)))
    index = F.col(rank) - F.col(lo)
    return (ranked.join(F.broadcast(places), (F.col("length") == F.col(key))
                        & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
            .select(*[F.col(c) for c in parts.columns if c not in ("sequence_id", "offset")],
                    (F.col(first) + F.floor(index / F.col(per))).alias("sequence_id"),
                    (F.col(at) + (index % F.col(per)) * F.col("length")).alias("offset")))


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from packed pieces that carry ``ids``: sequence_id, ids, doc starts.  A group
    holds ``size`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("offsets"))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 4096, forget: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``forget``: tasks leave no encoded words behind and
    encode less text at a time, for workers that go on to other stages."""
    return pack(stash(token_pieces(docs, tokenizer_path, size, forget=forget), "pieces"), size)


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
