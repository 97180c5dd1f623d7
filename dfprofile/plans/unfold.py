"""A nested report as long rows: one row a leaf, so that its sections can be filtered,
compared between runs and checked by SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, qcol

CONTEXT_SCHEMA = (
    "dataset_overview struct<rows: bigint, columns: int, total_missing: bigint>, "
    "column_summaries array<struct<name: string, type: string, stats: struct<mean: double, median: double, "
    "std_dev: double, min: double, max: double, outliers: bigint, skewness: double, unique_count: bigint, "
    "most_frequent: string, mode: double, variance: double, q1: double, q3: double, iqr: double, "
    "kurtosis: double, frequency: bigint>>>, "
    "correlations array<struct<column1: string, column2: string, correlation: double, strength: string, "
    "direction: string>>, outliers array<struct<column: string, count: bigint, percentage: double>>, "
    "distributions array<struct<column: string, type: string, is_normal: boolean>>")


def _leaves(value: Column, dt: T.DataType, path: str, section: str, at: Column) -> list[Column]:
    if isinstance(dt, T.StructType):
        return [leaf for f in dt.fields for leaf in _leaves(
            value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, section, at)]
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if is_numeric(dt):
        number = value.cast("double")
    elif isinstance(dt, T.ArrayType):
        text = F.array_join(F.transform(value, lambda x: x.cast("string")), ", ")
    else:
        text = value.cast("string")
    return [F.struct(F.lit(section).alias("section"), at.cast("int").alias("ord"), F.lit(path).alias("field"),
                     number.alias("number"), text.alias("text"))]


def _section(f: T.StructField) -> Column:
    dt = f.dataType
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
        return F.flatten(F.coalesce(F.transform(qcol(f.name), lambda x, i: F.array(
            *_leaves(x, dt.elementType, "", f.name, i))), F.array()))
    if isinstance(dt, T.StructType):
        return F.array(*_leaves(qcol(f.name), dt, "", f.name, F.lit(0)))
    return F.array(*_leaves(qcol(f.name), dt, f.name, "report", F.lit(0)))


def unfold(df: DataFrame) -> DataFrame:
    """``section, ord, field, number, text``: every leaf of every row that is not NULL.

    An array of structs is a section with ``ord`` from 0, a struct one with ``ord`` 0, plain columns make the
    section ``report``; fields of inner structs have dotted names.  Numbers are doubles, all else text; plain
    arrays are joined by a comma and a space.  An empty array of structs gives no rows."""
    rows = df.select(F.inline(F.concat(*[_section(f) for f in df.schema.fields])))
    return rows.where(F.col("number").isNotNull() | F.col("text").isNotNull())


def unfold_context(contexts: DataFrame) -> DataFrame:
    """``unfold`` of the JSON records of ``insight_context``."""
    return unfold(contexts.select(F.from_json("context", CONTEXT_SCHEMA).alias("c")).select("c.*"))
