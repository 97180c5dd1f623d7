"""Kendall tau-b (R3) without enumerating pairs of rows.

For a pair of columns (x, y) on their pairwise-complete rows:

    tau_b = (n0 - n1 - n2 + n3 - 2 D) / sqrt((n0 - n1) (n0 - n2))

with n0 = n(n-1)/2, n1 / n2 / n3 the pairs tied in x / y / both, and D the
discordant pairs (x_i < x_j, y_i > y_j).

Each column is cut into blocks of consecutive values with a bounded number of rows; a value of more rows
is a block of its own, whose rows are all tied.  Rows go once to their block of each column: there the
pairs of rows in one block are counted for every other column, sorted in memory (two rows of one block of
x, then those of one block of y that lie in different blocks of x).  Pairs of rows in different blocks of
both columns come from the counts per (block of x, block of y), the grid.

The grid's (or any cell table's) discordant pairs are counted by digits of an order-preserving code
of y: two values first differ at one digit, inside the group of equal higher digits (four levels for 10^9
codes).  There a grid splits x into blocks: pairs in different blocks come from the counts per
(block, digit), pairs in one block from its own rows; both are weighted
inversions of (x or block) against the digit, counted in memory by a vectorised
merge over groups whose size the grid bounds.  Cells are shuffled once a level.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import numeric_columns, qcol
from .correlation import MATRIX_SCHEMA, _matrix_rows, _with_ranks
from .freq import unpivot_pairs
from .numeric import NumericProfile
from ..session import materialize


DIGIT = 8  # bits of y told apart on a level
MAX_BLOCKS = 4096  # blocks of x a group, of a column
BLOCK_ROWS = 250_000  # of a block of a column, where that makes no more blocks


def _bits(n: int) -> int:
    return max(1, math.ceil(math.log2(max(n, 2))))


def kendall_cells(coded: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(pair, x, y, c)`` over pairwise-complete rows of the coded frame."""
    names = [f"p{i}" for i in range(len(pairs))]
    wide = coded.select(*[F.struct(qcol(a).alias("x"), qcol(b).alias("y")).alias(nm)
                          for nm, (a, b) in zip(names, pairs)])
    long = unpivot_pairs(wide, names, {"x": lambda c: F.col(c + ".x"),
                                       "y": lambda c: F.col(c + ".y")})
    return (long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .groupBy(F.col("column_name").alias("pair"), "x", "y")
            .agg(F.count(F.lit(1)).alias("c")))


def _count(group: np.ndarray, x: np.ndarray, digit: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row (sorted by group and x): its weight times the weight of rows of its group with
    smaller x and greater digit.  Two digits first differ at one bit: one pass a bit."""
    out = np.zeros(len(c))
    for bit in range(DIGIT):
        own = (group << DIGIT) | (digit >> (bit + 1))
        order = np.argsort(own, kind="stable")  # x stays in order
        g, v, w = own[order], x[order], c[order]
        one = (digit[order] >> bit) & 1
        upto = np.concatenate([[0.0], np.cumsum(np.where(one == 1, w, 0.0))])
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        new_x = new_g | np.concatenate([[True], v[1:] != v[:-1]])
        at = np.arange(len(g))
        before = upto[np.maximum.accumulate(np.where(new_x, at, 0))] - upto[np.maximum.accumulate(np.where(new_g, at, 0))]
        out[order] += np.where(one == 0, w * before, 0.0)
    return out


def _inversions(rows: DataFrame, group: list[str], order: str, batch: int = 200_000) -> DataFrame:
    """``(pair, d)``, a row per task and pair: weighted inversions of ``order`` against ``digit``
    within the groups.  Groups are whole within a task and handled some ``batch`` rows at a time."""

    def run(batches):
        total: dict[str, float] = {}
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> None:
            t = t.combine_chunks()
            names = t["pair"].dictionary_encode().combine_chunks()
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            pair = names.indices.to_numpy()
            for k in [pair, *(t[g].to_numpy() for g in group[1:])]:
                new[1:] |= k[1:] != k[:-1]
            d = _count(np.cumsum(new) - 1, t[order].to_numpy(), t["digit"].to_numpy().astype(np.int64), t["c"].to_numpy())
            for name, s in zip(names.dictionary.to_pylist(), np.bincount(pair, d)):
                total[name] = total.get(name, 0.0) + float(s)

        def last_group(t: pa.Table) -> int:
            """Where the last group begins."""
            n, start = t.num_rows, 0
            for g in group:
                k = t[g].combine_chunks()
                k = k.dictionary_encode().indices.to_numpy() if g == "pair" else k.to_numpy()
                diff = np.flatnonzero(k != k[-1])
                start = max(start, int(diff[-1]) + 1 if len(diff) else 0)
            return min(start, n)

        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= batch:
                t = pa.Table.from_batches(held)
                cut = last_group(t)
                if cut:
                    flush(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                size = max(t.num_rows - cut, 0) if cut else 0  # a group longer than a batch: wait for as many more
        if held:
            flush(pa.Table.from_batches(held))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], names=["pair", "d"])

    dealt = rows.select(*group, order, "digit", "c").repartition(*group).sortWithinPartitions(*group, order)
    return dealt.mapInArrow(run, "pair string, d double")


def _tied(cells: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``(pair, name)``: pairs of rows with the same ``keys``."""
    t = F.col("t").cast("double")
    return (cells.groupBy("pair", *keys).agg(F.sum("c").alias("t")).groupBy("pair")
            .agg(F.sum(t * (t - 1) / 2.0).alias(name)))


def _discordant(cells: DataFrame, code_bits: int) -> DataFrame:
    """``(pair, d)``: discordant pairs of the cell table, by digits of y."""
    shift = max((code_bits + 1) // 2, code_bits - _bits(MAX_BLOCKS))
    levels = (cells.select("pair", "x", "y", "c", F.explode(F.sequence(
                  F.lit(0), F.lit((code_bits - 1) // DIGIT))).alias("lvl"))
              .groupBy("pair", "lvl", F.expr(f"shiftright(y, {DIGIT} * (lvl + 1))").alias("prefix"),
                       F.shiftright("x", shift).alias("xb"), "x",
                       F.expr(f"CAST(shiftright(y, {DIGIT} * lvl) & {2 ** DIGIT - 1} AS INT)").alias("digit"))
              .agg(F.sum("c").cast("double").alias("c")))
    blocks = levels.groupBy("pair", "lvl", "prefix", "xb", "digit").agg(F.sum("c").alias("c"))
    return (_inversions(levels, ["pair", "lvl", "prefix", "xb"], "x")
            .unionByName(_inversions(blocks, ["pair", "lvl", "prefix"], "xb"))
            .groupBy("pair").agg(F.sum("d").alias("d")))


def _tau(sums: DataFrame) -> DataFrame:
    """``(pair, tau)`` from n, n1, n2, n3 and d."""
    n0 = F.col("n") * (F.col("n") - 1) / 2.0
    num = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2.0 * F.coalesce(F.col("d"), F.lit(0.0))
    den = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    return sums.select("pair", F.when(den > 0, num / den).alias("tau"))


def kendall_tau(cells: DataFrame, code_bits: int) -> DataFrame:
    """``(pair, tau)`` from the cell table; codes are non-negative longs below
    ``2 ** code_bits``."""
    base = cells.groupBy("pair").agg(F.sum("c").cast("double").alias("n"))
    for keys, name in ((["x"], "n1"), (["y"], "n2"), (["x", "y"], "n3")):
        base = base.join(_tied(cells, keys, name), "pair")
    return _tau(base.join(_discordant(cells, code_bits), "pair", "left"))


def _inversions_of(v: np.ndarray) -> int:
    """Pairs i < j with v[i] > v[j].  Two ranks first differ at one bit, within the group of equal
    higher bits: one pass a bit, after which the group's zeros stand before its ones."""
    if len(v) < 2:
        return 0
    r = np.unique(v, return_inverse=True)[1].astype(np.int32)
    total, at = 0, np.arange(len(r))
    for bit in range(int(r.max()).bit_length() - 1, -1, -1):
        one = (r >> bit) & 1
        group = r >> (bit + 1)
        new = np.concatenate([[True], group[1:] != group[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(r)))
        first = np.repeat(start, size)
        ones = np.cumsum(one) - one
        ones -= ones[first]
        zeros = np.repeat(np.add.reduceat(1 - one, start), size)
        total += int(ones[one == 0].sum())
        out = np.empty_like(r)
        out[np.where(one == 1, first + zeros + ones, at - ones)] = r
        r = out
    return total


def _ties(*keys: np.ndarray) -> int:
    """Pairs of rows with the same keys (sorted by them)."""
    if not len(keys[0]):
        return 0
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    t = np.diff(np.append(np.flatnonzero(new), len(new)))
    return int((t * (t - 1) // 2).sum())


def _block_sums(coded: DataFrame, cols: list[str], names: dict[tuple[int, int], str], size: int) -> DataFrame:
    """``(pair, n1, n2, n3, d)``, a row per task and pair: pairs of rows in one block of x, or in one of y
    and different ones of x.  ``names``: of the pairs (i, j), i < j."""
    k = len(cols)

    def count(i: int, codes: list[np.ndarray], total: dict[str, list[int]]) -> None:
        for j in range(k):
            both = ~np.isnan(codes[j])
            a, b = (codes[c][both].astype(np.int64) for c in (i, j))
            sums = total.setdefault(names[min(i, j), max(i, j)], [0, 0, 0, 0]) if i != j else None
            if i < j:
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                got = (_ties(a), 0, _ties(a, b), _inversions_of(b))
            elif i > j:
                order = np.lexsort((a, b))
                a, b = a[order], b[order]
                alone = (b & 1) == 1
                # by block of x, then y: rows of one block of x are no inversions
                order = np.lexsort((a, 2 * ((b >> 1) // size) + (b & 1)))
                got = (0, _ties(np.sort(a)), _ties(b[alone], a[alone]), _inversions_of(a[order]))
            else:
                continue
            for s, x in enumerate(got):
                sums[s] += x

    def run(batches):
        total: dict[str, list[int]] = {}
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> None:
            if held:
                t = pa.Table.from_batches(held)
                count(now >> 32, [t[f"k{c}"].to_numpy().astype(np.float64) for c in range(k)], total)
                held.clear()

        for b in batches:
            part = b.column("part").to_numpy()
            ends = np.flatnonzero(part[1:] != part[:-1]) + 1
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(part)]):
                if lo == hi:
                    continue
                if now != int(part[lo]):
                    flush()
                    now = int(part[lo])
                held.append(b.slice(lo, hi - lo))
        flush()
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), *(pa.array([float(v[s]) for v in total.values()]) for s in range(4))],
                names=["pair", "n1", "n2", "n3", "d"])

    rows = coded.select(F.posexplode(F.array(*[qcol(c) for c in cols])).alias("i", "code"),
                        *[qcol(c).alias(f"k{i}") for i, c in enumerate(cols)])
    part = F.shiftleft(F.col("i").cast("long"), 32) + F.expr(f"shiftright(code, 1) div {size}")
    rows = rows.where("code & 1 = 0").select(part.alias("part"), *[f"k{i}" for i in range(k)])
    return (rows.repartition("part").sortWithinPartitions("part")
            .mapInArrow(run, "pair string, n1 double, n2 double, n3 double, d double"))


def kendall_matrix(df: DataFrame, columns: list[str] | None = None,
                   config: ProfileConfig = DEFAULT, profile: NumericProfile | None = None
                   ) -> DataFrame:
    """Kendall tau-b long matrix, unrounded; NULL where undefined."""
    cols = columns or numeric_columns(df)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], MATRIX_SCHEMA)
    p = profile or NumericProfile(df, cols, config)
    size = max(BLOCK_ROWS, -(-p.n_rows() // MAX_BLOCKS))
    # twice the rows before a value, odd where the value alone has more rows than a block
    coded, _ = _with_ranks(df, cols, config, p, field=f"2 * cum_before + CAST(cnt > {size} AS INT)")
    coded = materialize(coded, "persist", p.n_rows())
    distinct = {r[0]: r[2] for r in p.summary_rows()}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    at = {c: i for i, c in enumerate(cols)}
    names = {(at[a], at[b]): f"p{i}" for i, (a, b) in enumerate(pairs)}
    block = lambda c: 2 * F.floor(F.shiftright(c, 1) / size) + c.bitwiseAND(1)
    grid = kendall_cells(coded.select(*[block(qcol(c)).alias(c) for c in cols]), pairs)
    grid = materialize(grid, "persist", p.n_rows() * len(pairs))
    own = {"x": F.col("x").bitwiseAND(1) == 1, "y": F.col("y").bitwiseAND(1) == 1}
    sums = grid.groupBy("pair").agg(F.sum("c").cast("double").alias("n"))
    parts = [_tied(grid.where(own["x"]), ["x"], "n1"), _tied(grid.where(own["y"]), ["y"], "n2"),
             _tied(grid.where(own["x"] & own["y"]), ["x", "y"], "n3"),
             _discordant(grid, _bits(2 * (p.n_rows() // size + 1))),
             _block_sums(coded, cols, names, size)]
    zero = {c: F.lit(0.0) for c in ("n1", "n2", "n3", "d")}
    rest = None
    for t in parts:
        t = t.select("pair", *[(F.col(c) if c in t.columns else z).alias(c) for c, z in zero.items()])
        rest = t if rest is None else rest.unionByName(t)
    rest = rest.groupBy("pair").agg(*[F.sum(c).alias(c) for c in zero])
    tau = {r["pair"]: r["tau"] for r in _tau(sums.join(rest, "pair")).collect()}
    grid.unpersist()
    coded.unpersist()
    values = {}
    for i, (a, b) in enumerate(pairs):
        values[(a, b)] = values[(b, a)] = tau.get(f"p{i}")
    for c in cols:
        values[(c, c)] = 1.0 if (distinct.get(c) or 0) > 1 else None
    rows = _matrix_rows(cols, lambda i, j: values.get((cols[i], cols[j])))
    return spark.createDataFrame(rows, MATRIX_SCHEMA)
