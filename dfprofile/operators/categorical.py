"""Categorical statistics (C1-C5): value counts, top-k, most frequent, uniques.

Values are counted by their first ``HEAD`` characters and, if longer, the MD5 of the
whole text, so no long text is shuffled to be counted.  Texts of the winners are fetched
afterwards: the first k groups of equal (count, head) hold the top k (heads order as their
texts do), only their digests are looked up, and each is combined map-side to one copy.
Top-k uses ``row_number() <= k`` partitioned by column, which Spark plans with a partial
``WindowGroupLimit`` before the shuffle, so no task sees more than k rows per column per
partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import qcol
from ..session import materialize
from .freq import string_frequencies, unpivot_pairs

CATEGORY_TYPES = ("categorical", "text", "boolean")
HEAD = 64  # characters of a value that are shuffled


def categorical_columns(df: DataFrame, config: ProfileConfig = DEFAULT, facts=None) -> list[str]:
    from .schema import SchemaFacts

    f = facts or SchemaFacts(df, config)
    tm = f.type_map()
    return [c for c in df.columns if tm.get(c) in CATEGORY_TYPES]


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value, count)`` for every non-null value."""
    cols = columns or df.columns
    return string_frequencies(df, cols).select(
        "column_name", "value", F.col("cnt").cast("long").alias("count"))


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """``(column_name, rank, value, count)`` with rank <= k, ordered by count
    descending then value ascending (D7: deterministic ties)."""
    w = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc("value"))
    return (freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column_name", F.col("rank").cast("int").alias("rank"), "value",
                    F.col("cnt").cast("long").alias("count")))


def _texts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column_name, value, digest)`` of non-null cells; short values have no digest."""
    cells = unpivot_pairs(df.select(*[qcol(c) for c in cols]), cols, {"value": lambda c: qcol(c).cast("string")})
    return cells.where(F.col("value").isNotNull()).withColumn(
        "digest", F.when(F.length("value") > HEAD, F.md5("value")))


def value_heads(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column_name, head, digest, cnt)``, one row per distinct value: short values are their own
    head, without a digest."""
    return (_texts(df, cols).groupBy("column_name", F.substring("value", 1, HEAD).alias("head"), "digest")
            .agg(F.count(F.lit(1)).alias("cnt")))


def top_of_heads(df: DataFrame, heads: DataFrame, k: int, config: ProfileConfig = DEFAULT) -> DataFrame:
    """``top_values`` of a ``value_heads`` table of ``df``; whole texts are fetched for the winners,
    and for values that tie with them in count and head."""
    first = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc("head"))
    edge = (heads.groupBy("column_name", "cnt", "head").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k)
            .withColumn("_before", F.sum("_n").over(first.rowsBetween(Window.unboundedPreceding, -1)))
            .where(F.coalesce("_before", F.lit(0)) < k).select("column_name", "cnt", "head"))
    near = materialize(heads.join(F.broadcast(edge), ["column_name", "cnt", "head"], "left_semi"))
    short = near.where(F.col("digest").isNull()).select("column_name", F.col("head").alias("value"), "cnt")
    wanted = near.where(F.col("digest").isNotNull()).select("column_name", "digest", "cnt")
    sizes = {r[0]: r[1] for r in wanted.groupBy("column_name").count().collect()}  # a row a column at most
    if not sizes:
        return top_values(short, k)
    if sum(sizes.values()) <= config.broadcast_row_limit:
        wanted = F.broadcast(wanted)
    found = (_texts(df, list(sizes)).where(F.col("digest").isNotNull())
             .join(wanted, ["column_name", "digest"]).groupBy("column_name", "digest")
             .agg(F.first("value").alias("value"), F.first("cnt").alias("cnt")).drop("digest"))
    return top_values(short.unionByName(found), k)


def top_categories(df: DataFrame, columns: list[str] | None = None, k: int | None = None,
                   config: ProfileConfig = DEFAULT) -> DataFrame:
    """The ``k`` (default 20) most frequent values of each column."""
    cols = columns or categorical_columns(df, config)
    return top_of_heads(df, materialize(value_heads(df, cols)), k or config.top_categories, config)


def categorical_stats(df: DataFrame, columns: list[str] | None = None,
                      config: ProfileConfig = DEFAULT, heads: DataFrame | None = None
                      ) -> DataFrame:
    """``column_name, unique_count, most_frequent, frequency``; an
    all-null column keeps its row with 0 / NULL / NULL."""
    spark = df.sparkSession
    cols = columns or categorical_columns(df, config)
    h = heads if heads is not None else materialize(value_heads(df, cols))
    per = h.groupBy("column_name").agg(F.count(F.lit(1)).cast("long").alias("unique_count"))
    most = top_of_heads(df, h, 1, config).select(
        "column_name", F.col("value").alias("most_frequent"), F.col("count").alias("frequency"))
    per = per.join(most, "column_name", "left")
    names = spark.createDataFrame([(c, i) for i, c in enumerate(cols)],
                                  "column_name string, ord int")
    return (names.join(F.broadcast(per) if len(cols) < 10_000 else per, "column_name", "left")
            .orderBy("ord")
            .select("column_name", F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
                    "most_frequent", "frequency"))


class CategoricalProfile:
    """Persisted table of value heads shared by stats, top-k and bar charts."""

    def __init__(self, df: DataFrame, columns: list[str], config: ProfileConfig = DEFAULT,
                 reuse: str = "persist", shared_freq: DataFrame | None = None,
                 shared_columns: list[str] | None = None):
        """``shared_freq``: an existing table with ``column_name, value, cnt``
        whose rows for ``shared_columns`` hold every value (NULL groups allowed);
        those columns are filtered from it, the rest get their own table."""
        self.df, self.cols, self.cfg = df, list(columns), config
        shared_cols = [c for c in self.cols if shared_freq is not None
                       and c in set(shared_columns or [])]
        own_cols = [c for c in self.cols if c not in set(shared_cols)]
        self.owned = None
        parts = []
        if shared_cols:
            parts.append(shared_freq.where(F.col("column_name").isin(shared_cols)
                                           & F.col("value").isNotNull())
                         .select("column_name", F.col("value").alias("head"),
                                 F.lit(None).cast("string").alias("digest"), "cnt"))
        if own_cols:
            self.owned = materialize(value_heads(df, own_cols), reuse,
                                     df.count() * len(own_cols))
            parts.append(self.owned)
        self.heads = None
        for p in parts:
            self.heads = p if self.heads is None else self.heads.unionByName(p)

    def stats(self) -> DataFrame:
        return categorical_stats(self.df, self.cols, self.cfg, self.heads)

    def top(self, k: int | None = None) -> DataFrame:
        return top_of_heads(self.df, self.heads, k or self.cfg.top_categories, self.cfg)

