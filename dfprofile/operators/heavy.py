"""Heavy hitters (C6): top values from a mergeable count sketch and one exact recount.

The sketch counts rows by hash slot, once a lane (an independent hash): at most ``lanes * slots``
rows a column, combined map-side, so neither values nor long texts are shuffled.  Sketches of two
tables add up to that of their union, so new files need no second look at old ones.

A slot's total bounds the count of each of its values from above.  Values whose slots are among the
``candidates`` fullest in every lane are recounted exactly; any other value lies in a lesser slot of
some lane, so the fullest of those bounds all counts not seen.  A row whose count is above that bound
has its exact rank; rows say so (``proven``) and carry the bound (``unseen``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qcol
from ..session import materialize
from .categorical import top_values

SLOTS, LANES, CANDIDATES = 1 << 16, 2, 1024


def _slot(lane: int, slots: int) -> Column:
    return F.pmod(F.xxhash64("column_name", "value", F.lit(lane)), F.lit(slots)).cast("int")


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    names = [f"c{i}" for i in range(len(columns))]
    cells = (df.select(*[qcol(c).cast("string").alias(n) for c, n in zip(columns, names)])
             .unpivot([], names, "column_name", "value").where(F.col("value").isNotNull()))
    known = F.create_map(*[F.lit(x) for pair in zip(names, columns) for x in pair])
    return cells.withColumn("column_name", known[F.col("column_name")])


def count_sketch(df: DataFrame, columns: list[str], slots: int = SLOTS, lanes: int = LANES) -> DataFrame:
    """``column_name, lane, slot, total``: rows by hash slot of the non-null values."""
    lane = F.explode(F.array(*[F.struct(F.lit(i).alias("lane"), _slot(i, slots).alias("slot"))
                               for i in range(lanes)])).alias("at")
    return (_cells(df, columns).select("column_name", lane)
            .groupBy("column_name", "at.lane", "at.slot").agg(F.count(F.lit(1)).alias("total")))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of the union of the sketched tables (same columns, slots and lanes)."""
    return (reduce(DataFrame.unionByName, sketches).groupBy("column_name", "lane", "slot")
            .agg(F.sum("total").alias("total")))


def heavy_hitters(df: DataFrame, columns: list[str], k: int = 20, slots: int = SLOTS, lanes: int = LANES,
                  candidates: int = CANDIDATES, sketch: DataFrame | None = None) -> DataFrame:
    """``column_name, rank, value, count, unseen, proven``: up to ``k`` values a column, ties by value.

    ``count`` is exact.  ``unseen`` bounds the count of every value that was not recounted; a row is
    ``proven`` where its count is above, and then it is row ``rank`` of the exact list.  ``sketch``:
    that of ``df``, if kept.  Columns without values give no rows.
    """
    order = Window.partitionBy("column_name", "lane").orderBy(F.desc("total"), F.asc("slot"))
    totals = sketch if sketch is not None else count_sketch(df, columns, slots, lanes)
    ranked = materialize(totals.withColumn("place", F.row_number().over(order))
                         .where(F.col("place") <= candidates + 1))
    full = ranked.where(F.col("place") <= candidates)
    cells = _cells(df, columns)
    for i in range(lanes):  # at most columns * candidates rows a lane
        lane = full.where(F.col("lane") == i).select("column_name", F.col("slot").alias(f"slot_{i}"))
        cells = cells.withColumn(f"slot_{i}", _slot(i, slots)).join(
            F.broadcast(lane) if len(columns) * candidates <= 1_000_000 else lane,
            ["column_name", f"slot_{i}"], "left_semi")
    counts = cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    unseen = (ranked.groupBy("column_name").agg(
        F.coalesce(F.max(F.when(F.col("place") > candidates, F.col("total"))), F.lit(0)).alias("unseen")))
    return (top_values(counts, k).join(unseen, "column_name")
            .withColumn("proven", F.col("count") > F.col("unseen")))
