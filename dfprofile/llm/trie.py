"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns; its name is its depth and the 128-bit sum of the
hashes of its turns with their places.  A node is known outside as (smallest member, depth): every
conversation has one node a depth.

Every node has an enter and an exit arc.  The arc after an enter arc is that of the first child, or the
node's own exit; the arc after an exit arc enters the next sibling, or leaves the parent.  The tour
is list-ranked distributedly: arcs are dealt out by ranges of (member, depth), along which the tour
mostly runs; each task doubles successors within its range, only arcs that are entered from another
range stay, and the shorter list is ranked in the same way (by doubling over joins once ranges no
longer shorten it).  Ranking carries the sums of leaves and savings to the tour's end, so a
subtree's sums are the difference of those at its enter and exit arcs.

Positions in conversations, prefix hashes and siblings come from scans along global orders
(``scan``), so no conversation, node or list of siblings is held by one task.  Lists of members are
written as strings by ranges and hashed as a stream.

Defined results: turns with null ``conv_id`` take no part; null turns come first; turns alike in
``turn`` are ordered by the hash of role and text, repeated rows stay one turn each; null roles and
texts are empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dfprofile.llm.common import cut, load, stash
from dfprofile.llm.scan import scan

BLOCK = 500_000  # arcs in a task
HOT_SHARE = 500  # a parent with more than this part of all nodes is broadcast: at most as many


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), digest of role and text, bytes of the text: every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    return scan(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")]).select(
        "conv", F.col("n_").alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, digest, bytes) of the rebuilt conversations, and all their ids: the first
    h turns of the family's first conversation, then the own ones after h."""
    turns = stash(turns, "turns")
    convs = cut(turns.select("conv").distinct())
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    heads = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), F.col("pos").alias("at"), "digest", "bytes")
    heads = convs.select("conv", (F.col("conv") - F.col("conv") % family).alias("base")).join(heads, "base").where(F.col("at") <= h)
    rows = heads.select("conv", F.lit(0).alias("own"), "at", "digest", "bytes").union(
        turns.where(F.col("pos") > h).select("conv", F.lit(1), "pos", "digest", "bytes"))
    return scan(rows, ["conv"], ["own", "at"]).select("conv", F.col("n_").alias("pos"), "digest", "bytes"), convs


def _contract(arcs: DataFrame, rows: int, block: int) -> DataFrame:
    """Each arc with the sums up to the last arc of its range that the tour runs through without
    leaving it, the arc behind (``nc``, ``ne``), and whether it is entered from outside."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # a range: about ``block`` rows
        t = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if t is None or not t.num_rows:
            return
        n = t.num_rows
        c, e = t["c"].to_numpy(), t["e"].to_numpy()
        inside = t["nc"].is_valid().to_numpy()
        nc, ne = (t[x].fill_null(0).to_numpy() for x in ("nc", "ne"))
        own, at = np.unique(c, return_inverse=True)
        wide = int(max(e.max(), ne.max())) + 1
        key = at * wide + e
        order = np.argsort(key)
        to = np.searchsorted(own, nc)
        inside = inside & (own[np.minimum(to, len(own) - 1)] == nc)
        want = to * wide + ne
        place = np.searchsorted(key, want, sorter=order)
        there = order[np.minimum(place, n - 1)]
        inside &= key[there] == want
        jump = np.append(np.where(inside, there, n), n)
        tail = np.append(np.where(inside, there, np.arange(n)), n)
        sums = [np.append(t[x].to_numpy(), 0) for x in ("s0", "s1", "s2")]
        head = np.ones(n + 1, bool)
        head[jump[:n]] = False
        while (jump != n).any():
            sums = [s + s[jump] for s in sums]
            jump, tail = jump[jump], tail[tail]
        tail = tail[:n]
        yield from pa.table({"c": t["c"], "e": t["e"], "nc": t["nc"].take(pa.array(tail)), "ne": t["ne"].take(pa.array(tail)),
                             **{f"s{i}": pa.array(s[:n]) for i, s in enumerate(sums)}, "head": pa.array(head[:n])}).to_batches()

    dealt = arcs.select("c", "e", "nc", "ne", "s0", "s1", "s2").repartitionByRange(-(-rows // block), "c", "e")
    return stash(dealt.mapInArrow(walk, "c long, e long, nc long, ne long, s0 long, s1 long, s2 long, head boolean"), "arcs")


def _plus(arcs: DataFrame, ranks: DataFrame, *carry: str) -> DataFrame:
    """Sums of arcs plus those of the arc behind."""
    r = ranks.select(F.col("c").alias("nc"), F.col("e").alias("ne"), *(F.col(f"s{i}").alias(f"r{i}") for i in range(3)),
                     *(F.col(x).alias(f"{x}_") for x in carry))
    return arcs.join(r, ["nc", "ne"], "left").select(
        "c", "e", *(F.col(f"{x}_").alias(x) for x in carry), *((F.col(f"s{i}") + F.coalesce(f"r{i}", F.lit(0))).alias(f"s{i}") for i in range(3)))


def _doubled(arcs: DataFrame) -> DataFrame:
    """Sums to the end of the list, by doubling successors in joins; keys are unique on both sides."""
    arcs = cut(arcs.select("c", "e", "nc", "ne", "s0", "s1", "s2"))
    while not arcs.where("nc is not null").isEmpty():
        arcs = cut(_plus(arcs, arcs, "nc", "ne"))
    return arcs.select("c", "e", "s0", "s1", "s2")


def list_rank(arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """c, e and the sums of ``s0``, ``s1``, ``s2`` from each arc to the end of its list, for arcs with
    names (c, e) and the names (nc, ne) of the arcs behind them."""
    rows = arcs.count()
    short = _contract(arcs, max(rows, 1), block)
    heads = short.where("head")
    if short.where("nc is not null").isEmpty():
        return short.select("c", "e", "s0", "s1", "s2")
    ranks = list_rank(heads, block) if 2 * heads.count() <= rows else _doubled(heads)
    return _plus(short, ranks)


def _hashes(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and the digest of the ascending, comma-joined members, for nodes that have any."""
    key = ["depth", "k1", "k2"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in key]
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            conv = b.column("conv").to_pylist()
            text = [",".join(map(str, conv[x:y])) for x, y in zip(at, [*at[1:], b.num_rows])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols), pa.array([conv[x] for x in at], pa.int64()),
                                              pa.array(text)], names=[*key, "conv", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, []
        for b in batches:
            for *k, text in zip(*(b.column(x).to_pylist() for x in [*key, "text"])):
                if k != last:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*key, "ends"])
                done = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, state.hexdigest())], names=[*key, "ends"])

    ranges = ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    lists = ranges.mapInArrow(write, "depth long, k1 long, k2 long, conv long, text string")
    return lists.repartition(*key).sortWithinPartitions(*key, "conv").mapInArrow(
        digest, "depth long, k1 long, k2 long, ends string")


def _parents(nodes: DataFrame, kids: DataFrame) -> DataFrame:
    """depth, k1, k2, up (the parent's member) of every node but the root.  Parents of very many are
    few, and broadcast; the others meet their children in a shuffled join."""
    most = max(nodes.count() // HOT_SHARE, 1000)
    own = nodes.select(F.col("depth").alias("pd"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv").alias("up")).join(
        kids.select("pd", "q1", "q2", "n_children"), ["pd", "q1", "q2"])
    below = nodes.where("depth > 0").select("depth", "k1", "k2", (F.col("depth") - 1).alias("pd"), "q1", "q2")
    own = cut(own)
    hot = F.broadcast(own.where(F.col("n_children") > most).drop("n_children"))  # HOT_SHARE rows at most
    cold = below.join(hot.drop("up"), ["pd", "q1", "q2"], "left_anti").join(own.drop("n_children"), ["pd", "q1", "q2"])
    return below.join(hot, ["pd", "q1", "q2"]).unionByName(cold).select("depth", "k1", "k2", "up")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes of the conversations ``convs`` (conv) with turns (conv, pos, digest, bytes): conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the places
    of its arcs in the tour, enter_at and exit_at."""
    key = ["depth", "k1", "k2"]
    rows = turns.withColumnRenamed("pos", "depth").withColumns(
        {"x1": F.xxhash64("depth", "digest"), "x2": F.xxhash64(F.lit("2"), "digest", "depth")}).drop("digest")
    rows = scan(rows, ["conv"], ["depth"], ("x1", "x2"))
    whole = {c: F.col(c).cast("decimal(20,0)") for c in ("x1", "x2", "x1_", "x2_")}

    def before(i: int):
        """The sum without the row's own hash, modulo 2**64."""
        d = whole[f"x{i}_"] - whole[f"x{i}"]
        top, span = (F.lit(str(2 ** n)).cast("decimal(21,0)") for n in (63, 64))
        return F.when(d >= top, d - span).when(d < -top, d + span).otherwise(d).cast("long")

    rows = stash(rows.select("conv", "depth", "bytes", F.col("x1_").alias("k1"), F.col("x2_").alias("k2"),
                             before(1).alias("q1"), before(2).alias("q2")), "prefixes")
    sizes = rows.groupBy("conv").agg(F.max("depth").alias("depth"))
    ends = rows.join(sizes, ["conv", "depth"]).select(*key, "conv").union(
        convs.join(sizes, "conv", "left_anti").select(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), "conv"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *(zero.alias(k) for k in key), "conv", "n_convs", zero.alias("bytes"), *(F.lit(None).cast("long").alias(q) for q in ("q1", "q2")))
    nodes = stash(rows.groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
                                         F.min("q1").alias("q1"), F.min("q2").alias("q2")).unionByName(root), "nodes")
    kids = stash(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("pd"), "q1", "q2").agg(
        F.count(F.lit(1)).alias("n_children"), F.min("conv").alias("first")), "kids")
    tree = nodes.drop("q1", "q2").join(kids.select(F.col("pd").alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"),
                                                   "n_children", "first"), key, "left")
    tree = stash(tree.join(_parents(nodes, kids), key, "left"), "tree")
    # siblings from the last to the first: the one before is the next to be entered
    next_ = scan(tree.where("depth > 0").select("depth", "up", "conv"), ["depth", "up"], [F.col("conv").desc()], previous="conv")
    toured = tree.join(next_.select("depth", "conv", F.col("previous_").alias("next")), ["depth", "conv"], "left")

    d, leaf = F.col("depth"), F.col("first").isNull()
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).cast("long")
    enter = F.struct((2 * d).alias("e"), F.when(leaf, F.col("conv")).otherwise(F.col("first")).alias("nc"),
                     F.when(leaf, 2 * d + 1).otherwise(2 * d + 2).alias("ne"), leaf.cast("long").alias("s1"), saved.alias("s2"))
    leave = F.struct((2 * d + 1).alias("e"), F.coalesce("next", "up").alias("nc"),
                     F.when(F.col("next").isNotNull(), 2 * d).when(F.col("up").isNotNull(), 2 * d - 1).alias("ne"),
                     zero.alias("s1"), zero.alias("s2"))
    arcs = toured.select(F.col("conv").alias("c"), F.explode(F.array(enter, leave)).alias("a")).select(
        "c", "a.e", "a.nc", "a.ne", F.lit(1).cast("long").alias("s0"), "a.s1", "a.s2")
    ranks = list_rank(stash(arcs, "tour"), block)
    n_arcs = 2 * tree.count()
    side = F.col("e") % 2
    sums = ranks.groupBy(F.col("c").alias("conv"), F.floor(F.col("e") / 2).alias("depth")).agg(
        *(F.sum(F.when(side == 0, F.col(f"s{i}")).otherwise(-F.col(f"s{i}"))).alias(f"t{i}") for i in (1, 2)),
        *((F.lit(n_arcs) - F.max(F.when(side == k, F.col("s0")))).alias(name) for k, name in ((0, "enter_at"), (1, "exit_at"))))
    out = tree.join(sums, ["conv", "depth"]).join(_hashes(ends), key, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), F.col("t1").alias("n_leaves"), F.col("t2").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "enter_at", "exit_at")


def q_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered(load(spark, sf_dir, "conversations")))).drop("enter_at", "exit_at")
