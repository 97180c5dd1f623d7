"""Column helpers: type classes, NaN folding, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric physical type; booleans are excluded."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def numeric_text(v: Column) -> Column:
    """A text's number; digits with a type letter behind them (``1d``, ``4f``) are none."""
    return F.when(~v.rlike(r"[0-9.]\s*[dDfF]\s*$"), v.try_cast("double"))


def qcol(name: str) -> Column:
    """Column by exact name, safe for names with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_double(name: str, dt: T.DataType | None = None) -> Column:
    """Cast to double and fold NaN to NULL (NaN is treated as missing)."""
    c = qcol(name).try_cast("double") if isinstance(dt, T.StringType) else qcol(name).cast("double")
    if dt is None or isinstance(dt, FLOAT_TYPES) or isinstance(dt, T.StringType):
        c = F.nanvl(c, F.lit(None).cast("double"))
    return c


def is_missing(name: str, dt: T.DataType) -> Column:
    """NULL, or NaN for floating columns (pandas counts NaN as missing)."""
    c = qcol(name)
    if isinstance(dt, FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def rnd(c: Column, digits: int = 4) -> Column:
    """Half-up rounding to a fixed number of decimals."""
    return F.round(c, digits)


def fields_of(df: DataFrame, names: list[str]) -> dict[str, T.DataType]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return {n: types[n] for n in names}


EXACT_INT = 2 ** 53  # integers up to here are doubles


def wide_bound(dt: T.DataType) -> str | None:
    """The magnitude beyond which values of an exact type may share a double (None: never)."""
    if isinstance(dt, T.LongType):
        return str(EXACT_INT)
    if isinstance(dt, T.DecimalType) and dt.precision > 15:
        return f"1e{15 - dt.scale}"
    return None


def residual(name: str, dt: T.DataType) -> Column:
    """What a wide value has beyond its double; (double, residual) orders and tells apart
    longs, and decimals of up to 31 digits."""
    c = qcol(name)
    if isinstance(dt, T.LongType):
        d = c.cast("double").try_cast("bigint")  # NULL where the double is 2^63
        diff = F.coalesce(c - d, (c - F.lit(2 ** 63 - 1)) - F.lit(1))
    else:
        t = f"decimal(37,{dt.scale})"
        diff = c.try_cast(t) - c.cast("double").try_cast(t)
    return F.when(c.isNotNull(), F.coalesce(diff.cast("double"), F.lit(0.0)))
