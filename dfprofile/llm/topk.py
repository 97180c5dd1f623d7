"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

A vector component v is an integer, split into impact digits v = 16*a + 4*b + c with b, c in 0..3
(a keeps the sign).  A posting segment holds one digit of all postings of a block of vectors; the
segments are stored in descending impact: first 16*a, then 4*b, then c.  A query adds segment after
segment to its scores.  What the later segments can still add lies between the sums of their largest
negative and positive impacts under the query, and, tighter, within the product of the norms of the
query and of the unseen remainders around their middle.  A vector leaves when its score plus that
bound is below the k-th best lower bound: never without this proof.  Those left are rescored exactly.

Vectors are indexed in blocks of ``block_rows``; each block of queries meets each block of vectors
once, in the task that its salt is dealt to.  That work, queries times vectors, is the search itself.

Defined results: vectors null, with a null id, or with null or non-finite components, take no part; only vectors of
the query's length are compared; an empty vector scores 0; ties go to the smaller id; a repeated id
that is not the query's own takes part as often as it occurs; an empty table gives no rows; other
columns are ignored.  A component or score that no 64-bit integer holds is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dfprofile.llm.common import cut, load

BLOCK = "dim int, block long, ids binary, impacts binary, spread binary, exact binary"
EXACT = 2 ** 53


def _floats(v: np.ndarray, w: np.ndarray) -> bool:
    """Whether floating-point sums of products are exact."""
    most = lambda x: float(np.abs(x).max(initial=0))
    return most(v) * most(w) * max(1, v.shape[1]) < EXACT


def segments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits (3, rows, dim) in descending impact, and the norms of the remainder's distance from
    its middle after one and after two segments (2, rows)."""
    a, b, c = v >> 4, (v >> 2) & 3, v & 3
    rest = np.stack([np.linalg.norm(4 * b + c - 7.5, axis=1), np.linalg.norm(c - 1.5, axis=1)])
    return np.stack([16 * a, 4 * b, c]), rest


def search_block(queries: np.ndarray, digits: np.ndarray, rest: np.ndarray, exact: np.ndarray,
                 own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: rows of the block that can be among its k best, and their exact scores.
    ``own[i, j]``: row j is not a candidate of query i."""
    q = queries.astype(np.float64)
    if not _floats(queries, exact):
        for i, x in enumerate(queries):
            rows = np.flatnonzero(~own[i])
            score = [sum(int(s) * int(t) for s, t in zip(x, exact[r])) for r in rows]
            yield i, rows, np.array(score, dtype=np.int64)
        return
    seg = digits.astype(np.float64)
    norm = np.linalg.norm(q, axis=1)
    total = q.sum(axis=1)
    first = q @ seg[0].T
    for i in range(len(q)):
        rows = np.flatnonzero(~own[i])
        score = first[i, rows]
        for level, (middle, top) in enumerate(((7.5, 15), (1.5, 3))):
            if len(rows) <= k:
                break
            slack = 1e-6 * (1 + norm[i]) * (1 + rest[level, rows])
            near = norm[i] * rest[level, rows] + slack
            low = np.maximum(score + middle * total[i] - near, score + top * np.minimum(q[i], 0).sum())
            high = np.minimum(score + middle * total[i] + near, score + top * np.maximum(q[i], 0).sum())
            left = high >= np.partition(low, len(low) - k)[len(low) - k]
            rows, score = rows[left], score[left]
            score = score + seg[level + 1][rows] @ q[i]
        best = exact[rows] @ queries[i]
        if len(rows) > k:
            left = best >= np.partition(best, len(best) - k)[len(best) - k]
            rows, best = rows[left], best[left]
        yield i, rows, best


def valid(embedding: str) -> Column:
    x = F.col(embedding).cast("array<double>")
    return F.col(embedding).isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def index(vectors: DataFrame, block_rows: int = 8192) -> DataFrame:
    """Blocks of vectors (vec_id long, v array<long>) as impact-ordered segments."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        seq = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal seq
            ids, rows = zip(*held.pop(dim))
            v = np.array(rows, dtype=np.int64).reshape(len(ids), dim)
            digits, rest = segments(v)
            seq += 1
            cols = [dim, seq, np.array(ids, np.int64).tobytes(), digits.tobytes(), rest.tobytes(), v.tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 4))],
                names=[c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                if len(own) >= block_rows:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return vectors.where("vec_id is not null").mapInArrow(build, BLOCK)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 8192,
           query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows of ``vectors`` for each row of
    ``queries`` (both vec_id long, v array<long>); a row is no candidate of a query with its id."""
    rows = cut(index(vectors, block_rows))
    asks = index(queries, query_rows).select("dim", F.col("ids").alias("q_ids"), F.col("exact").alias("q"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = {c: b.column(c)[r].as_py() for c in b.schema.names}
                ids, q_ids = (np.frombuffer(x[c], np.int64) for c in ("ids", "q_ids"))
                shape = (len(ids), x["dim"])
                exact = np.frombuffer(x["exact"], np.int64).reshape(shape)
                digits = np.frombuffer(x["impacts"], np.int64).reshape(3, *shape)
                rest = np.frombuffer(x["spread"], np.float64).reshape(2, len(ids))
                q = np.frombuffer(x["q"], np.int64).reshape(len(q_ids), x["dim"])
                found = [(np.full(min(k, len(at)), q_ids[i]), *_best(ids[at], best, k))
                         for i, at, best in search_block(q, digits, rest, exact, q_ids[:, None] == ids, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[j] for f in found]), pa.int64()) for j in range(3)],
                    names=["query_id", "vec_id", "score"])

    # each block of queries meets each block of vectors of its length, once: the blocks of vectors
    # are dealt over salts, those of queries are copied to each, and pairs are scored where they meet
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salts = max(1, min(parts, rows.count()))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    asks = asks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = rows.join(asks, ["dim", "salt"]).mapInArrow(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    def whole(v: Column) -> Column:
        y = F.lit(float(scale)) * v
        return F.when(F.abs(y) >= F.lit(2.0 ** 63), F.raise_error(F.lit("a component is beyond 64 bits"))).otherwise(F.floor(y))

    x = F.transform(F.col("embedding").cast("array<double>"), whole)
    return table.where(valid("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"),
                                                  x.cast("array<long>").alias("v"))


def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(load(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 50 = 0"))
