"""Running counts, sums and neighbours along a global order, without a task that holds a whole group.

Rows are dealt out by ranges of (group, order) and sorted within each range; every task scans its
own range and the ranges' ends, one row a task, are carried on the driver.  A group of any size is
thereby spread over as many tasks as it fills.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dfprofile.llm.common import stash


def _starts(cols: list[np.ndarray], last: tuple | None) -> np.ndarray:
    """Which rows begin another group than the row before them."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    new[0] = last is None or tuple(int(c[0]) for c in cols) != last
    return new


def scan(df: DataFrame, group: list[str], order: list, sums: tuple[str, ...] = (), previous: str | None = None) -> DataFrame:
    """``df`` with ``n_`` (the row's position in its group, from 1), ``<c>_`` for every ``c`` of
    ``sums`` (the sum up to the row, modulo 2**64) and ``previous_`` (the value of the row before it
    in its group, else null).  Columns of ``group``, ``sums`` and ``previous`` are longs without nulls."""
    rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    extra = ["part_", "i_", "n_", *(f"{c}_" for c in sums), *(["previous_"] if previous else [])]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in extra)])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, last, carry, before = TaskContext.get().partitionId(), 0, None, [np.uint64(0)] * (1 + len(sums)), None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(g).to_numpy() for g in group]
            new = _starts(cols, last)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = [np.full(n, part), np.arange(i, i + n)]
            for k, x in enumerate([np.ones(n, np.int64), *(b.column(c).to_numpy() for c in sums)]):
                x = x.view(np.uint64)
                upto = np.cumsum(x, dtype=np.uint64) + carry[k]
                upto = upto - np.where(start >= 0, (upto - x)[start], np.uint64(0))
                carry[k] = upto[-1]
                out.append(upto.view(np.int64))
            last, i = tuple(int(c[-1]) for c in cols), i + n
            arrays = [pa.array(x.astype(np.int64)) for x in out]
            if previous:
                v = b.column(previous).to_numpy()
                p = np.concatenate([[before or 0], v[:-1]])
                none = new.copy()
                none[0] |= before is None
                arrays.append(pa.array(p.astype(np.int64), mask=none))
                before = int(v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], schema=pa.schema([*b.schema, *((c, pa.int64()) for c in extra)]))

    done = stash(rows.mapInArrow(local, schema), "scan")
    held = [*group, "n_", *(f"{c}_" for c in sums), *([previous] if previous else [])]
    ends = done.groupBy("part_").agg(F.min_by(F.struct(*group), "i_").alias("first"), F.max_by(F.struct(*held), "i_").alias("last"))
    carried, own, acc = {}, None, None  # a row per task
    for r in sorted(ends.collect()):
        first, last = tuple(r["first"]), tuple(r["last"])
        key, vals = last[:len(group)], list(last[len(group):])
        if own == first:
            carried[r["part_"]] = (own, acc)
            if key == first:
                k = 1 + len(sums)
                vals[:k] = [x + y for x, y in zip(vals[:k], acc[:k])]
        own, acc = key, vals

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, cols = b.column("part_").to_numpy(), [b.column(g).to_numpy() for g in group]
            out = {c: b.column(c) for c in b.schema.names}
            for p in np.unique(part).tolist():
                if p not in carried:
                    continue
                key, acc = carried[p]
                mine = part == p
                for c, v in zip(cols, key):
                    mine &= c == v
                for c, x in zip(["n_", *(f"{c}_" for c in sums)], acc):
                    v = out[c].to_numpy().view(np.uint64)
                    out[c] = pa.array(np.where(mine, v + np.uint64(x % 2 ** 64), v).view(np.int64))
                if previous:
                    first = mine & (b.column("i_").to_numpy() == 0)
                    v, none = out["previous_"].fill_null(0).to_numpy(), out["previous_"].is_null().to_numpy(zero_copy_only=False)
                    out["previous_"] = pa.array(np.where(first, acc[-1], v), mask=none & ~first)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return done.mapInArrow(apply, schema).drop("part_", "i_")
