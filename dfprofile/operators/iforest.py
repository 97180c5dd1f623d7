"""Isolation-forest outliers (O4) for single numeric columns.

* Samples: ``iforest_trees`` samples of ``min(256, n)`` rows per column.  When
  the column holds at least trees x 256 values, consecutive blocks of one seeded
  hash order give disjoint samples (one bounded top-k, no per-tree hashing);
  otherwise each tree hashes rows with its own seed (small inputs only).
* Trees: ``groupBy(column, tree).applyInPandas`` builds each isolation tree on
  <= 256 values (random split uniform in [min, max), depth limit ceil(log2 256))
  and emits its leaves as intervals with path length depth + c(size).
* In one dimension the whole forest is a step function: the leaves of a column
  (<= trees x 256) are merged on executors into intervals with their mean path
  length, one row per column reaches the driver, and values are scored by an
  Arrow-batched ``pandas_udf`` doing a vectorised binary search
  (``np.searchsorted``) — never row-at-a-time, and without a join on values.
* The cut is the exact ``(1 - contamination)`` quantile of the scores over all
  rows (from the score frequency table), so about 10 % of rows are flagged.

scikit-learn's random stream cannot be reproduced, so flags match its
semantics, not its exact picks.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import numeric_columns, qcol, rnd
from .freq import quantiles_from_ranked, running_counts, unpivot_pairs
from .numeric import NumericProfile

EULER_GAMMA = 0.5772156649015329
LEAF_SCHEMA = "column_name string, tree int, lo double, hi double, path double"
STEP_SCHEMA = "column_name string, starts array<double>, scores array<double>"


def average_path_length(n: int) -> float:
    """c(n): expected path length of an unsuccessful BST search."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


def _grow(values: np.ndarray, lo: float, hi: float, depth: int, max_depth: int, rng, out: list):
    if depth >= max_depth or len(values) <= 1 or values.min() == values.max():
        out.append((lo, hi, depth + average_path_length(len(values))))
        return
    split = rng.uniform(values.min(), values.max())
    left = values[values <= split]
    right = values[values > split]
    _grow(left, lo, split, depth + 1, max_depth, rng, out)
    _grow(right, split, hi, depth + 1, max_depth, rng, out)


def _build_trees(seed: int, max_depth: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        col = pdf["column_name"].iloc[0]
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree, zlib.crc32(col.encode())])
        leaves: list = []
        _grow(pdf["value"].to_numpy(dtype=float), -math.inf, math.inf, 0, max_depth, rng, leaves)
        return pd.DataFrame([(col, tree, lo, hi, path) for lo, hi, path in leaves],
                            columns=["column_name", "tree", "lo", "hi", "path"])
    return build


def _merge_trees(sizes: dict[str, int]):
    """A column's leaves (<= trees x samples) as one step function: starts of the elementary
    intervals and the anomaly score on each."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        col = pdf["column_name"].iloc[0]
        ends = np.concatenate([pdf["lo"].to_numpy(), pdf["hi"].to_numpy()])
        starts, at = np.unique(ends, return_inverse=True)
        path = pdf["path"].to_numpy()
        total = np.cumsum(np.bincount(at, np.concatenate([path, -path]), len(starts)))[:-1]
        c_n = average_path_length(sizes[col])
        mean = total / pdf["tree"].nunique()
        scores = np.power(2.0, -mean / c_n) if c_n > 0 else np.full(len(total), 0.5)
        return pd.DataFrame({"column_name": [col], "starts": [starts[:-1]], "scores": [scores]})
    return merge


def _step_score(tables: dict):
    """The score of a value: the step whose interval [start, next start) holds it."""
    @F.pandas_udf("double")
    def score(names: pd.Series, values: pd.Series) -> pd.Series:
        out = np.full(len(values), np.nan)
        for c in names.unique():
            if c not in tables:
                continue
            starts, sc = tables[c]
            idx = (names == c).to_numpy()
            pos = np.searchsorted(starts, values.to_numpy()[idx], side="right") - 1
            out[idx] = sc[pos]
        return pd.Series(out)
    return score


def isolation_scores(df: DataFrame, columns: list[str], row_key: str | Column | None = None,
                     config: ProfileConfig = DEFAULT, profile: NumericProfile | None = None
                     ) -> tuple[DataFrame, NumericProfile, dict]:
    """``(column_name, value, cnt, score)`` over the frequency table, and the forest as a step
    function per column."""
    p = profile or NumericProfile(df, columns, config)
    counts = p.counts()
    t, m = config.iforest_trees, config.iforest_samples
    key = (qcol(row_key) if isinstance(row_key, str) else row_key) if row_key is not None \
        else F.monotonically_increasing_id()
    keyed = df.select(key.cast("long").alias("_key"),
                      *[F.nanvl(qcol(c).cast("double"), F.lit(None).cast("double")).alias(c)
                        for c in columns])
    long = unpivot_pairs(keyed, columns, {"value": lambda c: qcol(c), "_key": lambda c: F.col("_key")})
    long = long.where(F.col("value").isNotNull())
    big = [c for c in columns if counts[c] >= t * m]
    small = [c for c in columns if 0 < counts[c] < t * m]
    samples = []
    if big:
        h = F.xxhash64(F.col("_key"), F.col("column_name"), F.lit(config.seed))
        w = Window.partitionBy("column_name").orderBy(h, "_key")
        s = (long.where(F.col("column_name").isin(big)).withColumn("_rn", F.row_number().over(w))
             .where(F.col("_rn") <= t * m)
             .select("column_name", ((F.col("_rn") - 1) / m).cast("int").alias("tree"), "value"))
        samples.append(s)
    if small:
        trees = F.explode(F.sequence(F.lit(0), F.lit(t - 1))).alias("tree")
        e = long.where(F.col("column_name").isin(small)).select("column_name", "_key", "value", trees)
        h = F.xxhash64(F.col("_key"), F.col("column_name"), F.col("tree"), F.lit(config.seed))
        w = Window.partitionBy("column_name", "tree").orderBy(h, "_key")
        s = (e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= m)
             .select("column_name", "tree", "value"))
        samples.append(s)
    sample = samples[0] if len(samples) == 1 else samples[0].unionByName(samples[1])
    max_depth = int(math.ceil(math.log2(max(2, m))))
    leaves = sample.groupBy("column_name", "tree").applyInPandas(
        _build_trees(config.seed, max_depth), LEAF_SCHEMA)
    sizes = {c: min(m, counts[c]) for c in columns}
    steps = leaves.groupBy("column_name").applyInPandas(_merge_trees(sizes), STEP_SCHEMA)
    tables = {r["column_name"]: (np.asarray(r["starts"]), np.asarray(r["scores"]))
              for r in steps.collect()}  # one row per column
    score = _step_score(tables)
    freq = p.freq().select("column_name", "value", "cnt").where(
        F.col("column_name").isin(list(tables)))
    return freq.withColumn("score", score("column_name", "value")), p, tables


def isolation_forest_outliers(df: DataFrame, columns: list[str] | None = None,
                              row_key: str | Column | None = None,
                              config: ProfileConfig = DEFAULT, with_keys: bool = True,
                              profile: NumericProfile | None = None) -> DataFrame:
    """O4 with the O1 output schema (method ``isolation_forest``)."""
    cols = columns or numeric_columns(df)
    scored, p, tables = isolation_scores(df, cols, row_key, config, profile)
    sf = (scored.groupBy("column_name", F.col("score").alias("value"))
          .agg(F.sum("cnt").alias("cnt")).withColumn("bucket", F.lit(0)))
    ranked = running_counts(sf, ["column_name"], "value")
    n = p.summary().select("column_name", "n")
    cut = quantiles_from_ranked(ranked, n, {"cut": 1.0 - config.iforest_contamination})
    flagged = scored.join(F.broadcast(cut), "column_name").where(F.col("score") > F.col("cut"))
    counts = flagged.groupBy("column_name").agg(F.sum("cnt").cast("long").alias("outlier_count"))
    base = (n.join(counts, "column_name", "left").select(
        "column_name", F.lit("isolation_forest").alias("method"),
        F.coalesce("outlier_count", F.lit(0)).cast("long").alias("outlier_count"),
        F.coalesce(rnd(F.try_divide(F.col("outlier_count") * 100.0, F.col("n")), 2),
                   F.lit(0.0)).alias("outlier_percentage")))
    if not with_keys:
        return base
    key = (qcol(row_key) if isinstance(row_key, str) else row_key) if row_key is not None \
        else F.monotonically_increasing_id()
    keyed = df.select(key.cast("long").alias("_key"),
                      *[F.nanvl(qcol(c).cast("double"), F.lit(None).cast("double")).alias(c)
                        for c in cols])
    long = unpivot_pairs(keyed, cols, {"value": lambda c: qcol(c), "_key": lambda c: F.col("_key")})
    # rows meet the step function, not the table of flagged values: no join on values
    found = long.where(F.col("value").isNotNull() & F.col("column_name").isin(list(tables))).withColumn(
        "score", _step_score(tables)("column_name", "value"))
    hits = found.join(F.broadcast(cut), "column_name").where(F.col("score") > F.col("cut"))
    w = Window.partitionBy("column_name").orderBy("_key")
    first = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= config.max_outlier_keys)
    keys = first.groupBy("column_name").agg(F.sort_array(F.collect_list("_key")).alias("outlier_keys"))
    return (base.join(F.broadcast(keys), "column_name", "left")  # keys: <= k rows
            .withColumn("outlier_keys", F.coalesce("outlier_keys", F.array().cast("array<bigint>"))))
