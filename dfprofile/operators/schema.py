"""Schema profile: semantic types (S6), column schema (S7), type narrowing (S8),
missing-data analysis (Q6) and the dataset summary.

One job computes every per-column fact: an unpivot of all columns as strings,
a ``(column_name, value)`` frequency aggregate (map-side combined; NULL is its
own group) and a per-column aggregate over it.  Parse checks (``try_cast``) run
once per distinct value, not once per row.  Only k rows reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import (numeric_text, DATETIME_TYPES, FLOAT_TYPES, INTEGRAL_TYPES, is_numeric,
                                 qcol, rnd)
from .freq import unpivot_pairs

# Semantic type names.
NUMERIC, CATEGORICAL, DATETIME, TEXT, BOOLEAN, UNKNOWN = (
    "numeric", "categorical", "datetime", "text", "boolean", "unknown")

# Longer strings are grouped by digest, never shuffled whole just to be counted.
SHORT_STRING = 64

# Bytes per value for the memory estimate (D12); strings use their UTF-8 length.
FIXED_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.DecimalType: 16, T.BooleanType: 1, T.DateType: 4,
    T.TimestampType: 8, T.TimestampNTZType: 8,
}

FACTS_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("spark_type", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_missing", T.LongType()),
    T.StructField("n_unique", T.LongType()),
    T.StructField("n_numeric", T.LongType()),
    T.StructField("n_datetime", T.LongType()),
    T.StructField("mean_length", T.DoubleType()),
    T.StructField("string_bytes", T.LongType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    T.StructField("n_float_exact", T.LongType()),
    T.StructField("data_type", T.StringType()),
])


def _profiled(dt: T.DataType) -> bool:
    """Types whose values we count and compare; arrays/maps/structs/binary are
    only counted for missing values."""
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def _value_expr(name: str, dt: T.DataType):
    c = qcol(name)
    if isinstance(dt, FLOAT_TYPES):
        c = F.nanvl(c, F.lit(None).cast(dt))
    if not _profiled(dt):
        # Only missingness matters: a non-null marker keeps the group count at 1.
        return F.when(c.isNotNull(), F.lit("")).cast("string")
    return c.cast("string")


def _infer(dt: T.DataType, n_rows, n_missing, n_unique, n_numeric, n_datetime,
           mean_length, cfg: ProfileConfig) -> str:
    """Decision list S6 (numeric parse before datetime parse for strings, D6)."""
    if isinstance(dt, DATETIME_TYPES):
        return DATETIME
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    if is_numeric(dt):
        return NUMERIC
    if not isinstance(dt, T.StringType):
        return UNKNOWN
    n_present = n_rows - n_missing
    if n_present == 0:
        return UNKNOWN  # D4
    if n_numeric == n_present:
        return NUMERIC
    if n_datetime == n_present:
        return DATETIME
    if n_rows and n_unique / n_rows < cfg.categorical_ratio:
        return CATEGORICAL
    if mean_length is not None and mean_length > cfg.text_mean_length:
        return TEXT
    return CATEGORICAL


class SchemaFacts:
    """Per-column facts, reused by every schema operator.

    Numeric-typed columns take their facts from a ``NumericProfile`` (its
    persisted ranked frequency table: counts, distinct values, min / max and a
    float round-trip count in one small pass); every other column from one
    persisted string frequency table (missing, distinct, parse checks and
    lengths evaluated once per distinct value).  A full profile shares both
    tables with the numeric and categorical analyses, so the raw data is
    unpivoted once per family.
    """

    def __init__(self, df: DataFrame, config: ProfileConfig = DEFAULT, reuse: str = "persist"):
        from .numeric import NumericProfile

        self.df = df
        self.cfg = config
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.cols = [f.name for f in df.schema.fields]
        self.numeric_typed = [c for c in self.cols if is_numeric(self.types[c])]
        self.others = [c for c in self.cols if c not in set(self.numeric_typed)]
        self.numeric = NumericProfile(df, self.numeric_typed, config, reuse)
        self.reuse = reuse
        self._string_freq = None
        self._max_len: dict = {}
        self._rows = None

    def string_freq(self) -> DataFrame | None:
        """Cells ``(column_name, value, digest, cnt, len, bytes, num, is_ts)``
        for the non-numeric columns; NULL is its own group.

        Values up to ``SHORT_STRING`` characters are grouped by the value itself
        (and parsed once per distinct value); longer ones by the MD5 of the
        whole text, with their flags computed map-side, so long texts are never
        shuffled just to be counted."""
        if not self.others:
            return None
        if self._string_freq is None:
            from ..session import materialize

            long = unpivot_pairs(self.df.select(*[qcol(c) for c in self.others]), self.others,
                                 {"s": lambda c: _value_expr(c, self.types[c])})
            sv = F.col("s")
            short = F.length(sv) <= SHORT_STRING
            big = ~short
            rows = long.select(
                "column_name", F.when(short, sv).alias("value"),
                F.when(big, F.unhex(F.md5(sv))).alias("digest"),
                F.length(sv).alias("len"), F.octet_length(sv).alias("bytes"),
                F.when(big, numeric_text(sv)).alias("num_long"),
                F.when(big, sv.try_cast("timestamp").isNotNull()).alias("ts_long"))
            cells = rows.groupBy("column_name", "value", "digest").agg(
                F.count(F.lit(1)).alias("cnt"), F.first("len").alias("len"),
                F.first("bytes").alias("bytes"), F.first("num_long").alias("num_long"),
                F.max("ts_long").alias("ts_long"))
            v = F.col("value")
            cells = cells.select(
                "column_name", "value", "digest", "cnt", "len", "bytes",
                F.coalesce(numeric_text(v), F.col("num_long")).alias("num"),
                F.coalesce(v.try_cast("timestamp").isNotNull() & v.isNotNull(),
                           F.col("ts_long"), F.lit(False)).alias("is_ts"))
            bound = self.numeric.n_rows() * len(self.others)
            self._string_freq = materialize(cells, self.reuse, bound)
        return self._string_freq

    def short_value_columns(self) -> list[str]:
        """Non-numeric columns whose every value is keyed by itself in
        ``string_freq`` (so categorical statistics can reuse it)."""
        self.rows()
        return [c for c in self.others if (self._max_len.get(c) or 0) <= SHORT_STRING]

    def _other_rows(self) -> dict:
        f = self.string_freq()
        if f is None:
            return {}
        w = F.col("cnt")
        present = F.col("value").isNotNull() | F.col("digest").isNotNull()
        num = F.col("num")
        facts = f.groupBy("column_name").agg(
            F.sum(w).cast("long").alias("n_rows"),
            F.sum(F.when(~present, w).otherwise(0)).cast("long").alias("n_missing"),
            F.count(F.when(present, 1)).cast("long").alias("n_unique"),
            F.sum(F.when(num.isNotNull(), w).otherwise(0)).cast("long").alias("n_numeric"),
            F.sum(F.when(F.col("is_ts"), w).otherwise(0)).cast("long").alias("n_datetime"),
            (F.sum(F.when(present, w * F.col("len"))) / F.sum(F.when(present, w))).alias("mean_length"),
            F.sum(w * F.col("bytes")).cast("long").alias("string_bytes"),
            F.min(num).alias("min_value"), F.max(num).alias("max_value"),
            F.sum(F.when(num.cast("float").cast("double") == num, w).otherwise(0)).cast("long")
            .alias("n_float_exact"),
            F.max("len").alias("max_length"))
        got = {r["column_name"]: r.asDict() for r in facts.collect()}
        self._max_len = {c: r["max_length"] for c, r in got.items()}
        return got

    def _numeric_rows(self) -> dict:
        if not self.numeric_typed:
            return {}
        p = self.numeric
        n_rows = p.n_rows()
        basic = p.basic_rows()
        out = {}
        for c in self.numeric_typed:
            n, n_distinct, mn, mx, exact = basic[c]
            n = n or 0
            out[c] = {"n_rows": n_rows, "n_missing": n_rows - n, "n_unique": n_distinct or 0,
                      "n_numeric": n, "n_datetime": 0, "mean_length": None,
                      "string_bytes": None, "min_value": mn, "max_value": mx,
                      "n_float_exact": exact or 0}
        return out

    def rows(self) -> list:
        if self._rows is not None:
            return self._rows
        got = {**self._numeric_rows(), **self._other_rows()}
        rows = []
        for i, c in enumerate(self.cols):
            r = got[c]
            dt = self.types[c]
            if not _profiled(dt):
                r = {**r, "n_unique": None}  # values are not compared, only counted
            rows.append((c, i, dt.simpleString(), r["n_rows"], r["n_missing"], r["n_unique"],
                         r["n_numeric"], r["n_datetime"], r["mean_length"], r["string_bytes"],
                         r["min_value"], r["max_value"], r["n_float_exact"],
                         _infer(dt, r["n_rows"], r["n_missing"], r["n_unique"], r["n_numeric"],
                                r["n_datetime"], r["mean_length"], self.cfg)))
        self._rows = rows
        return rows

    def facts(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self.rows(), FACTS_SCHEMA)

    def type_map(self) -> dict[str, str]:
        return {r[0]: r[-1] for r in self.rows()}

    def row_count(self) -> int:
        rows = self.rows()
        return rows[0][3] if rows else self.df.count()

    def memory_bytes(self) -> int:
        total = 0
        for r in self.rows():
            dt = self.types[r[0]]
            width = next((w for t, w in FIXED_WIDTH.items() if isinstance(dt, t)), None)
            if width is not None:
                total += width * r[3]
            elif isinstance(dt, T.StringType):
                total += r[9] or 0
            else:
                total += 8 * r[3]
        return total

    def release(self):
        self.numeric.release()
        if self._string_freq is not None and self.reuse == "persist":
            self._string_freq.unpersist()


def infer_types(df: DataFrame, config: ProfileConfig = DEFAULT,
                facts: SchemaFacts | None = None) -> DataFrame:
    """``(column_name, data_type)``."""
    f = facts or SchemaFacts(df, config)
    return f.facts().select("column_name", "data_type")


def sample_values(df: DataFrame, row_key: str | None = None, k: int = 5,
                  columns: list[str] | None = None) -> DataFrame:
    """First ``k`` non-null values of every column in ``row_key`` order, as
    ``(column_name, sample_values ARRAY<STRING>)``.

    One bounded top-k job (``orderBy(key).limit`` plans as a per-partition
    TakeOrdered + merge) covers all columns; a column still short of ``k`` values
    gets its own bounded top-k over its non-null rows.  No window over a whole
    column, nothing unbounded on the driver.
    """
    spark = df.sparkSession
    cols = columns or [c for c in df.columns
                       if c != "__key" and _profiled(df.schema[c].dataType)]
    key = qcol(row_key) if row_key else F.monotonically_increasing_id()
    types = {c: df.schema[c].dataType for c in cols}
    keyed = df.select(key.alias("__key"), *[qcol(c) for c in cols])
    # String casts run after the top-k, on the few selected rows only.
    as_str = [_value_expr(c, types[c]).alias(c) for c in cols]
    head = keyed.orderBy("__key").limit(4 * k).select("__key", *as_str).collect()
    out = []
    for c in cols:
        vals = [r[c] for r in head if r[c] is not None][:k]
        if len(vals) < k and len(head) == 4 * k:
            present = _value_expr(c, types[c]).isNotNull()
            more = (keyed.where(present).select("__key", qcol(c)).orderBy("__key").limit(k)
                    .select(_value_expr(c, types[c]).alias(c)).collect())
            vals = [r[0] for r in more]
        out.append((c, vals))
    return spark.createDataFrame(out, "column_name string, sample_values array<string>")


def schema_profile(df: DataFrame, row_key: str | None = None,
                   config: ProfileConfig = DEFAULT, facts: SchemaFacts | None = None
                   ) -> DataFrame:
    """``column_name, data_type, missing_count, missing_percentage (2 dp),
    unique_count, sample_values``."""
    f = facts or SchemaFacts(df, config)
    s = sample_values(df, row_key, config.sample_values)
    base = f.facts()
    pct = rnd(F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")), 2)
    return (base.join(s, "column_name", "left").orderBy("ord")
            .select("column_name", "data_type", F.col("n_missing").alias("missing_count"),
                    pct.alias("missing_percentage"), F.col("n_unique").alias("unique_count"),
                    F.coalesce("sample_values", F.array().cast("array<string>"))
                    .alias("sample_values")))


def dataset_summary(df: DataFrame, config: ProfileConfig = DEFAULT,
                    facts: SchemaFacts | None = None) -> DataFrame:
    """``row_count, column_count, total_missing, memory_usage_mb`` (D12 estimate)."""
    f = facts or SchemaFacts(df, config)
    rows = f.rows()
    total_missing = sum(r[4] for r in rows)
    mem = round(f.memory_bytes() / (1024 ** 2), 2)
    return df.sparkSession.createDataFrame(
        [(f.row_count(), len(rows), total_missing, mem)],
        "row_count bigint, column_count int, total_missing bigint, memory_usage_mb double")


def missing_data(df: DataFrame, config: ProfileConfig = DEFAULT,
                 facts: SchemaFacts | None = None) -> DataFrame:
    """Q6: ``column_name, missing_count, missing_percentage, high_missing`` where
    the flag marks a missing share above ``missing_value_threshold``."""
    f = facts or SchemaFacts(df, config)
    frac = F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows"))
    return f.facts().orderBy("ord").select(
        "column_name", F.col("n_missing").alias("missing_count"),
        rnd(frac * 100.0, 2).alias("missing_percentage"),
        (frac > F.lit(config.missing_value_threshold)).alias("high_missing"))


def _int_fit(lo, hi) -> str:
    for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)):
        if lo >= -(2 ** (bits - 1)) and hi <= 2 ** (bits - 1) - 1:
            return name
    return "bigint"


def type_narrowing(df: DataFrame, config: ProfileConfig = DEFAULT,
                   facts: SchemaFacts | None = None, apply: bool = False) -> DataFrame:
    """Recommended narrower storage type per column.

    Integers get the smallest signed type holding [min, max]; a double column is
    ``float`` when every value survives a float round trip; a string column with
    ``unique / rows < 0.5`` is ``category`` (dictionary encoded in Parquet).
    Returns ``column_name, current_type, recommended_type``; with ``apply=True``
    returns ``df`` with the numeric casts applied instead.
    """
    f = facts or SchemaFacts(df, config)
    out = []
    for r in f.rows():
        c, dt = r[0], f.types[r[0]]
        cur = dt.simpleString()
        rec = cur
        n_present = r[3] - r[4]
        if isinstance(dt, INTEGRAL_TYPES) and n_present > 0:
            rec = _int_fit(r[10], r[11])
        elif isinstance(dt, T.DoubleType) and n_present > 0 and r[12] == n_present:
            rec = "float"
        elif isinstance(dt, T.StringType) and r[3] and r[5] / r[3] < config.categorical_ratio:
            rec = "category"
        out.append((c, cur, rec))
    if apply:
        casts = {c: rec for c, cur, rec in out if rec not in (cur, "category")}
        return df.select(*[qcol(c).cast(casts[c]).alias(c) if c in casts else qcol(c)
                           for c in df.columns])
    return df.sparkSession.createDataFrame(
        out, "column_name string, current_type string, recommended_type string")
