"""Data quality (Q1-Q5): missing share, duplicate rows, constant columns, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import FLOAT_TYPES, is_missing, numeric_columns, qcol, rnd
from ..functions.labels import quality_label


def _digest(df: DataFrame) -> list:
    """128 bits of the whole row (values and which are NULL), so that wide rows
    and long texts are no shuffle keys."""
    parts = [x for c in df.columns for x in (qcol(c).isNull(), qcol(c))]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "_h1"), (2, "_h2"))]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q2: ``(duplicate_rows, row_count)``: rows beyond the first copy; NULLs
    compare equal.  One shuffle of row digests after a map-side combine."""
    g = df.select(*_digest(df)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                 F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("row_count"))


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q4: numeric columns with exactly one distinct non-null value."""
    cols = columns or numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string")
    def value(c: str):
        x, dt = qcol(c), df.schema[c].dataType
        return F.nanvl(x, F.lit(None).cast(dt)) if isinstance(dt, FLOAT_TYPES) else x

    # compared in the column's own type: large integers keep their identity
    one = df.agg(*[(F.min(value(c)) == F.max(value(c))).alias(f"c{i}") for i, c in enumerate(cols)])
    flags = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("same"))
                      for i, c in enumerate(cols)])
    return one.select(F.inline(flags)).where("same").select("column_name")


def _total(parts: list):
    """Sum of many columns as a balanced tree."""
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) - len(parts) % 2:]
    return parts[0] if parts else F.lit(0)


def missing_cells(df: DataFrame) -> DataFrame:
    """Q3: ``(missing_cells, total_cells)``: one aggregate of the rows' missing counts."""
    m = _total([is_missing(f.name, f.dataType).cast("long") for f in df.schema.fields])
    return df.agg(F.coalesce(F.sum(m), F.lit(0)).cast("long").alias("missing_cells"),
                  (F.count(F.lit(1)) * len(df.columns)).cast("long").alias("total_cells"))


def quality_score(df: DataFrame, config: ProfileConfig = DEFAULT) -> DataFrame:
    """Q1/Q5: ``overall_score, missing_data_percentage, duplicate_rows,
    duplicate_percentage, constant_columns, assessment`` (2 dp).  Single-row
    results meet as scalar subqueries, without a join."""
    d = duplicate_rows(df)
    c = constant_columns(df).agg(F.count(F.lit(1)).cast("long"))
    j = missing_cells(df).select("*", d.select("duplicate_rows").scalar().alias("duplicate_rows"),
                                 d.select("row_count").scalar().alias("row_count"),
                                 c.scalar().alias("constant_columns"))
    miss = F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("total_cells")), F.lit(0.0))
    dup = F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("row_count")), F.lit(0.0))
    score = (F.lit(100.0) - F.least(miss, F.lit(30.0)) - F.least(dup, F.lit(20.0))
             - F.least(F.col("constant_columns") * 5.0, F.lit(20.0)))
    score = F.greatest(score, F.lit(0.0))
    return j.select(rnd(score, 2).alias("overall_score"),
                    rnd(miss, 2).alias("missing_data_percentage"),
                    "duplicate_rows", rnd(dup, 2).alias("duplicate_percentage"),
                    "constant_columns", quality_label(score).alias("assessment"))
