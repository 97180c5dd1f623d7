"""Exact Jaccard join of word-shingle sets: size-banded tiles, hashed bitmap signatures, verification.

Two sets of Jaccard similarity t or more share a shingle among the first ``n - ceil(t*n) + 1`` of
each, in any order common to all; shingles of few documents come first here, by a count sketch of
fixed size.  Documents that share such a shingle meet in its tiles, one for each size band (a factor
of 1/t; similar sets lie in the same or in neighbouring bands).  In a tile, bitmap signatures bound
the overlap from above (128 bits in the tiles, 1024 or the size for the pairs left): bit i holds the parity of the shingles hashed to i, so the bits in which two
signatures differ count no more than the shingles only one set has.  Pairs within bounds are decided
by intersecting their sorted sets.

Equal sets are one node.  In tiles of a few nodes all pairs are compared at once; in larger ones each node
meets one first node, which is linear; links found so are contracted to components.  While larger tiles
hold more pairs of different components than the nodes warrant, and that helps, this is done again with another first
node in each tile.  Then the pairs of a tile whose nodes lie in different components are compared (512 bits),
so that no link that can join two components is lost, and groups of near copies are not expanded into all
their pairs.  Tiles of the same nodes are one; a pair is
left to the next tile that both nodes are in; and shingles of a prefix that no other prefix of the
bands near holds lower the bound of the overlap: of two nodes, that whose prefix ends first has all such
shingles of its own alone.  Set hashes have 64 bits.

Defined results: null and empty texts (no words) have 0 shingles and link with nothing; a text with
fewer words than a shingle has one shingle, all its words; repeated rows link as equal sets; where
all ids of a component are null, so is its id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dfprofile.llm.common import checked, cut, drop_stash, fresh, load, pieces, stash, text_bytes
from dfprofile.llm.graph import components

SLOTS = 1 << 20  # of the count sketch
CHUNK = 1 << 14
FEW = 16  # rows of a tile whose pairs are all compared at once
WIDE = 8  # words of the signatures that tell a tile's pairs apart
TURNS = 8  # first nodes tried in a tile, at most, before all its pairs are compared
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * K2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (a string array without nulls).  Words are the
    runs between ASCII white space, A-Z lower-cased; each distinct word is hashed once."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    at = coded.indices.to_numpy()
    rows = split.offsets.to_numpy()
    rows = rows - rows[0]
    if b"" in words:  # around leading and trailing white space
        full = np.array([bool(w) for w in words])[at]
        rows = np.concatenate([[0], np.cumsum(full)])[rows]
        at = at[full]
    h = h[at]
    x = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        x = _mix(x * K1 + h[i:i + len(x)])
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(x[a:b - width + 1]))
        else:
            y = np.zeros(min(1, b - a), np.uint64)
            for i in range(a, b):
                y = _mix(y * K1 + h[i:i + 1])
            out.append(y)
    return out


def _signature(s: np.ndarray) -> tuple[int, int, bytes]:
    """Parity bits by hash: 1024 or, in a larger set, the next power of two of its size; and the
    same folded to 128."""
    bits = 1 << max(10, (len(s) - 1).bit_length())
    odd = np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))
    return *_fold(odd.view(np.int64), 2).tolist(), odd.tobytes()


def _fold(words: np.ndarray, size: int) -> np.ndarray:
    """The signature that ``size`` words would have had."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _node(digest: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(digest, digest_size=8, salt=seed.to_bytes(8, "little")).digest(),
                          "little", signed=True)


def _scan(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Documents (doc_id, mark: a hash of the text, n, digest, node, s0, s1) and, in rows of their own, sketch chunks."""
    schema = "doc_id long, mark long, n int, digest binary, node long, s0 long, s1 long, sig binary, chunk int, counts binary"
    arrow = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SLOTS, np.uint32)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)],
                                              names=[c.split()[0] for c in schema.split(", ")])

        for b in pieces(batches, "text", 4 << 20, 10_000):
            rows = []
            ids = (b.column(c).to_pylist() for c in ("doc_id", "mark"))
            for i, mark, s in zip(*ids, shingle_sets(b.column("text"), width)):
                sketch[s >> np.uint64(44)] += 1  # distinct shingles; two in one slot count once
                d = _digest(s)
                rows.append((i, mark, len(s), d, _node(d, seed), *_signature(s), None, None))
            yield batch(rows)
        for c in range(0, SLOTS, CHUNK):
            if (part := sketch[c:c + CHUNK]).any():
                yield batch([(None, None, None, None, None, None, None, None, c, part.tobytes())])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("mark"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, schema)


def _sketch(scanned: DataFrame) -> np.ndarray:
    """Sum of the partitions' sketches, in steps of a quarter of a power of two (1 MB)."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                part = np.frombuffer(x, np.uint32).astype(np.uint64)
                sums[c] = sums[c] + part if c in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()])],
                names=["chunk", "counts"])

    chunks = scanned.where("chunk is not null").select("chunk", "counts").repartition("chunk")
    out = np.zeros(SLOTS, np.uint64)
    for c, x in chunks.mapInArrow(total, "chunk int, counts binary").collect():  # SLOTS counters at most
        out[c:c + CHUNK] = np.frombuffer(x, np.uint64)
    return np.round(4 * np.log2(1.0 + out)).astype(np.uint8)


def _prefix_rows(docs: DataFrame, width: int, percent: int, seed: int, order) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = order.value.astype(np.uint64) << np.uint64(56), set()
        for b in pieces(batches, "text", 4 << 20, 10_000):
            keys, nodes, bands, places, ends = [], [], [], [], []
            for s in shingle_sets(b.column("text"), width):
                node = _node(_digest(s), seed)
                if not len(s) or node in seen:
                    continue
                if len(seen) < 1 << 17:
                    seen.add(node)
                first = len(s) - -(-percent * len(s) // 100) + 1
                # the order: frequency, then hash; its value is the shingle's key
                rank = counts[s >> np.uint64(44)] | (s >> np.uint64(8))
                low = np.unique(np.partition(rank, first - 1)[:first]).view(np.int64)
                keys.append(low)
                nodes.append(np.full(len(low), node, np.int64))
                bands.append(np.full(len(low), int(math.log(len(s)) / step), np.int32))
                places.append(np.arange(len(low), dtype=np.int32))
                ends.append(places[-1] == len(low) - 1)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, bands, places, ends)],
                                                 names=["key", "node", "band", "place", "end"])

    step = math.log(100 / percent) * (1 + 1e-9)  # similar sizes differ by one band at most
    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        rows, "key long, node long, band int, place int, end boolean")


SIDE = ["node", "band", "n", "s0", "s1", "alone", "lone", "last"]  # what a row tells of its node


def _possible(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Whether sizes, signatures and shingles proven alone leave the similarity of two nodes of a tile
    possible.  ``alone``: those before the tile's key in no other prefix; ``lone``: those in the whole
    prefix, which the other node lacks if its prefix ends no earlier."""
    n, m = x("n").cast("long"), y("n").cast("long")
    differ = sum((F.bit_count(x(s).bitwiseXOR(y(s))) for s in ("s0", "s1")), F.lit(0))
    both = F.least(n - x("alone"), m - y("alone"),
                   F.when(x("last") <= y("last"), n - x("lone")).otherwise(m - y("lone")))
    return (((100 + percent) * both >= percent * (n + m))
            & ((100 + percent) * (n + m - differ) >= 2 * percent * (n + m)))


def _of(side: str) -> Callable[[str], Column]:
    return lambda c: F.col(f"{side}.{c}")


def _screen(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that the full signatures leave possible."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = []
            for x, y in zip(b.column("sig_a").to_pylist(), b.column("sig_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                differ.append(int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum(dtype=np.int64)))
            size = b.column("size").to_numpy()
            left = (100 + percent) * (size - np.array(differ, np.int64)) >= 2 * percent * size
            yield b.select(["a", "b"]).filter(pa.array(left))

    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .select("a", "b", (F.col("n_a").cast("long") + F.col("n_b")).alias("size"), "sig_a", "sig_b")
            .mapInArrow(screen, "a long, b long"))


def _verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that are similar, by their whole sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = checked(nodes.join(reps.select("node", "rep"), "node").select(F.col("node").alias("want"), "rep"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            out = {}
            for node, s in zip(b.column("want").to_pylist(), shingle_sets(b.column("text"), width)):
                if _node(_digest(s), seed) == node:  # an id may stand for several texts
                    out[node] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())],
                                             names=["node", "set"])

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")))
    found = stash(rows.select("want", "text").mapInArrow(sets, "node long, set binary"), "sets")
    once = found.dropDuplicates(["node"]) if found.count() > wanted.count() else found
    side = lambda x: once.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    links = cut(pairs.select("a", "b").join(side("b"), "b").join(side("a").join(pairs.select("a").distinct(), "a"), "a")
                .mapInArrow(intersect, "a long, b long"))
    drop_stash(found)
    return links


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows in the tile of their own band and in that of the next."""
    return rows.withColumn("tile", F.explode(F.array("band", F.col("band") + 1)))


def _shared(prefix: DataFrame) -> DataFrame:
    """Rows of keys that nodes share within a band or with a neighbouring band, told by a mask of the
    bands modulo 64 (``met``), and the last row of each node.  ``c``: the key's rows, or more."""
    key = Window.partitionBy("key")
    told = prefix.withColumns({"x": F.min("node").over(key), "y": F.max("node").over(key), "c": F.count(F.lit(1)).over(key),
                               "mask": F.bit_or(F.expr("shiftleft(1L, pmod(band, 64))")).over(key)})
    near = "getbit(mask, pmod(band + 1, 64)) = 1 or getbit(mask, pmod(band - 1, 64)) = 1"
    told = told.withColumn("met", F.expr(f"x <> y and (c > bit_count(mask) or {near})")).where("met or end")
    return told.select("key", "node", "band", "place", "met", F.col("c").cast("int").alias("c")).distinct()


def _few(rows: DataFrame, percent: int) -> DataFrame:
    """All possible pairs (b, a) of tiles of ``FEW`` rows at most: each row sees those after it."""
    after = Window.partitionBy("key").orderBy("band", "node").rowsBetween(1, FEW - 1)
    seen = rows.select("key", *SIDE, F.collect_list(F.struct(*SIDE)).over(after).alias("others"))
    fit = F.filter("others", lambda y: (y["band"] <= F.col("band") + 1) & _possible(F.col, lambda c: y[c], percent))
    pairs = seen.select("node", F.explode(F.transform(fit, lambda y: y["node"])).alias("other"))
    return pairs.select(F.greatest("node", "other").alias("b"), F.least("node", "other").alias("a"))


def _near(rows: DataFrame, percent: int, turn: int = 0) -> DataFrame:
    """Possible pairs (b, a) of each node and one node of each of its tiles: the first or, in a later
    ``turn``, any one of another component."""
    order, apart = ["node"], F.lit(True)
    if turn:
        order, apart = [F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node", "root"], F.col("x.root") != F.col("y.root")
    firsts = rows.groupBy("key", "band").agg(F.min(F.struct(*order, *[c for c in SIDE if c not in ("node", "band")])).alias("first"))
    firsts = firsts.select("key", F.explode(F.array("band", F.col("band") - 1)).alias("tile"), "first.*").alias("y")
    near = rows.alias("x").join(firsts, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.tile"))
                                & (F.col("x.node") != F.col("y.node")) & apart & _possible(_of("x"), _of("y"), percent))
    return near.select(F.col("x.node").alias("b"), F.col("y.node").alias("a"))


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with their ``root``, of tiles with nodes of different components; of two nodes, one was the
    other's first.  ``after``: the node's next tile."""
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a tile of the same nodes as another has the same pairs: of these, that with the most shingles alone
    name = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    mixed = (rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("c"),
                                       name(1).alias("f"), name(2).alias("g"), F.sum("alone").alias("alone"))
             .where("x <> y and c > 2").groupBy("c", "f", "g").agg(F.max_by("key", F.struct("alone", "key")).alias("key"))
             .select("key"))
    # two nodes that share the next tile too are left to it, so a pair comes once for each run of tiles
    after = F.lead("key").over(Window.partitionBy("node").orderBy("place"))
    return cut(rooted.join(mixed, "key").withColumn("after", after))


def _apart(left: DataFrame) -> tuple[int, int]:
    """The pairs of different components in the tiles of ``left``, and its rows."""
    sizes = left.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("c"))
    tiles = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
    n, pairs = tiles.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
    return int(pairs or 0), int(n or 0)


def _wide(reps: DataFrame) -> DataFrame:
    """node, w0, w1, ...: ``WIDE`` words of its signature."""
    names = [f"w{i}" for i in range(WIDE)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [_fold(np.frombuffer(x, np.int64), WIDE) for x in b.column("sig").to_pylist()]
            words = np.array(words, np.int64).reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays([b.column("node"), *(pa.array(np.ascontiguousarray(w)) for w in words.T)],
                                             names=["node", *names])

    return reps.where("n > 0").select("node", "sig").mapInArrow(fold, "node long, " + ", ".join(f"{w} long" for w in names))


def _ends(pairs: DataFrame, p: str, q: str) -> DataFrame:
    return pairs.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))


def _late(left: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Possible pairs (a, b) of all nodes of different components that share a tile of ``left``."""
    wide = left.drop("place").join(_wide(reps), "node")
    x, y = wide.alias("x"), _tiles(wide).alias("y")
    differ = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(WIDE)), F.lit(0))
    size = F.col("x.n").cast("long") + F.col("y.n")
    late = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.tile"))
                  & (F.col("x.root") != F.col("y.root"))
                  & F.coalesce(F.col("x.after") != F.col("y.after"), F.lit(True))
                  & ((F.col("x.band") != F.col("y.band")) | (F.col("x.node") < F.col("y.node")))
                  & _possible(_of("x"), _of("y"), percent) & ((100 + percent) * (size - differ) >= 2 * percent * size))
    return cut(_screen(_ends(late, "x.node", "y.node").distinct(), reps, percent))


def similar_groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, root (a node of the component), component_id (its
    smallest document id) of every document."""
    spark = docs.sparkSession
    for seed in range(16):
        scanned = stash(_scan(docs, width, seed), "scan")
        base = scanned.where("chunk is null")
        reps = cut(base.groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("s0").alias("s0"), F.first("s1").alias("s1"),
            F.first("sig").alias("sig"),
            F.min("digest").alias("d0"), F.max("digest").alias("d1")))
        if not reps.where("d0 <> d1").limit(1).count():
            break
    else:
        raise ValueError("different texts share a name under every seed")
    order = spark.sparkContext.broadcast(_sketch(scanned))
    prefix = _prefix_rows(docs, width, percent, seed, order)
    nodes = reps.where("n > 0").select("node", "n", "s0", "s1")
    rows = _shared(prefix).join(nodes, "node")
    # shingles that are in no other prefix of the bands near: another node of the tile holds all of its
    # shingles up to its prefix's last in its prefix, so it lacks those of them that come before that
    own = Window.partitionBy("node")
    met = F.sum(F.col("met").cast("int"))
    rows = rows.withColumns({"alone": F.col("place") + 1 - met.over(own.orderBy("place")),
                             "lone": F.max("place").over(own) + 1 - met.over(own), "last": F.max("key").over(own)})
    rows = stash(rows.where("met").select("key", *SIDE, "place", "c"), "tiles")

    # all pairs of small tiles; in others, each node with one of the first nodes
    some, many = rows.where(F.col("c") <= FEW), rows.where(F.col("c") > FEW).drop("c")
    near = cut(_screen(_few(some, percent).union(_near(many, percent)).distinct(), reps, percent))
    tried = pairs = cut(near.groupBy("b").agg(F.min("a").alias("a")))
    links = _verify(docs, reps, pairs, width, percent, seed)
    roots = cut(components(links))

    # again with others, as long as that leaves far fewer pairs of different components; not where those
    # are in proportion to the nodes and few of them possible
    left = _mixed(many, roots)
    drop_stash(rows)
    apart, n = _apart(left)
    late, size = None, reps.count()
    for turn in range(1, TURNS):
        if apart <= 2 * n:
            break
        if apart <= 16 * size:
            late = _late(left, reps, percent)
            if 8 * late.count() <= size:
                break
            late = None
        found = _screen(_near(left, percent, turn).distinct(), reps, percent)
        pairs = cut(found.groupBy("b").agg(F.min_by("a", F.xxhash64("a", "b")).alias("a"))
                    .join(tried, ["a", "b"], "left_anti"))
        links = cut(links.union(_verify(docs, reps, pairs, width, percent, seed)))
        tried, roots = cut(tried.unionByName(pairs)), cut(components(links))
        left, before = _mixed(left.drop("root", "after"), roots), apart
        apart, n = _apart(left)
        if 10 * apart > 9 * before:
            break

    # all pairs of nodes of different components
    late = _late(left, reps, percent) if late is None else late
    late = late.union(_ends(near, "a", "b")).distinct().join(_ends(tried, "a", "b"), ["a", "b"], "left_anti")
    root_of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    late = cut(late.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
               .where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"))
    if late.limit(1).count():
        links = links.union(_verify(docs, reps, late, width, percent, seed))
        roots = cut(components(links))

    # smallest document id of each component
    ids = reps.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = ids.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = ids.join(lowest, "root").select("node", "root", "component_id")
    return base.join(ids, "node").select(
        "doc_id", "mark", F.col("n").cast("long").alias("n_shingles"), "root",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one of each group of similar documents: the one with the smallest
    id (null: the largest), of rows with that id the one with the smallest text hash, of equal rows
    any one.  Documents without words all stay."""
    id_, mark, rank, gone_id, gone_mark = fresh(docs, "id_", "mark_", "rank_", "gone_id", "gone_mark")
    rows = cut(similar_groups(docs, width, percent).where("n_shingles > 0")
               .select("doc_id", "mark", "root", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark").alias("k")))
    kept = rows.groupBy("root").agg(F.min("k").alias("best"))
    rows = rows.join(kept, "root")
    as_ = [F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)]
    gone = checked(rows.where("k <> best").select(*as_).distinct())
    twice = checked(rows.where("k = best").groupBy("doc_id", "mark").count().where("count > 1").select(*as_))
    marked = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64(text_bytes()))
    same = F.col(id_).eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark))
    left = marked.join(gone, same, "left_anti")
    order = Window.partitionBy(id_, mark).orderBy(F.lit(0))
    first = (left.join(twice, same, "left_semi").withColumn(rank, F.row_number().over(order))
             .where(F.col(rank) == 1).drop(rank))
    return left.join(twice, same, "left_anti").unionByName(first).select(*[F.col(f"`{c}`") for c in docs.columns])


def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(load(spark, sf_dir, "documents"), width=3, percent=90).select(
        "doc_id", "n_shingles", "component_id")
