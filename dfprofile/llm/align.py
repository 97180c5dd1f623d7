"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

A document's text, with a space before it, is cut into tokens by a byte-level vocabulary (A) and by a
sentencepiece vocabulary (B).  Every token points to its farthest-right overlapping token of the
other side, or to itself where both sides end at once; successors are doubled over whole arrays
until nothing moves, and every token then points to the terminal token of its component.  Equal
terminals are one group.

Both vocabularies cut a text before a space that follows another character than white space, and on
both sides of a newline that stands alone between such characters (checked where a vocabulary is
opened), so a text is read as a row of units between those borders, and each distinct unit of a
batch is tokenized and aligned once.

A batch of documents becomes one row of a table in the shared folder: the units' links as numbers of
the batch's distinct id pairs, and the documents as numbers of units, packed as one binary value, so
that Spark moves bytes and never spreads millions of array elements over its vectors.  Each row is a
row group, as readers hold a row group at a time.  The pairs of all batches are then counted by
grouping, after adding them up within tasks; counts go back to the batches as a broadcast if they are
``most_broadcast`` rows or fewer, else in a shuffled join.

Defined results: null and empty texts, and texts that either side's tokens do not give back byte by
byte (as those with U+2581), have no tokens: zeros and the empty string.  Null and repeated ids
keep a row each; texts of any length are read whole; an empty table gives no rows; other columns
are ignored.  Strings of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dfprofile.llm.common import drop_stash, give_back, load, pieces, stash

# Fixed value: the split pattern of byte-level vocabularies with ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BORDER = re.compile(r"(?<=\S)(?= )|(?<=\S)(?=\n\S)")
MEMO = 40_000  # units kept by a task, in each of two generations
JOINED = 20_000  # units tokenized in one call
SHIFT = 32  # an id pair as one number: id of A above, id of B below


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others in order from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both vocabularies, and the tokens of units that were met lately."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken

        model = json.load(open(a_path))["model"]
        letters = _byte_letters()
        spelt = {k: i for k, i in model["vocab"].items() if all(c in letters for c in k)}
        special = {t["content"] for t in json.load(open(a_path)).get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in k): i for k, i in spelt.items() if k not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{a_path}: ids do not follow the order of merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.a_bytes[i] = b
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            if "\n" in p or re.search("[^▁]▁", p):
                raise ValueError(f"{b_path}: a piece reaches over a border")
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        self.newline, self.space = ranks[b"\n"], self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(b) for b in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        ids = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.words = pa.array([before + i for before in ("", ";", ",", "|") for i in ids])
        self.per_kind = len(ids)
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def _a_joined(self, units: list[str], glue: str) -> list[bytes]:
        """Ids of A of each unit; ``glue`` is the newline between units, or none if each begins with one."""
        out = []
        for i in range(0, len(units), JOINED):
            part = units[i:i + JOINED]
            ids = np.array(self.a.encode_ordinary(glue.join(part)), "<i4")
            at = np.flatnonzero(ids == self.newline)
            if glue:
                cuts = zip([0, *(at + 1)], [*at, len(ids)])
            else:
                cuts = zip(at, [*at[1:], len(ids)])
            got = [ids[x:y].tobytes() for x, y in cuts]
            if len(got) != len(part):
                raise AssertionError("a unit holds another newline")
            out += got
        return out

    def _learn(self, units: list[str]) -> None:
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        spaced, lines, odd = [], [], []
        for u in units:
            if u in self.older:
                self.memo[u] = self.older[u]
            elif len(u.split()) != 1 or u[1:2].isspace() or u[-1].isspace():
                odd.append(u)
            else:
                (lines if u[0] == "\n" else spaced).append(u)
        for some, glue in ((spaced, "\n"), (lines, "")):
            a = self._a_joined(some, glue) if some else []
            for u, x, y in zip(some, a, self._b_units(some)):
                self.memo[u] = x, y
        for u, y in zip(odd, self._b_units(odd)):
            self.memo[u] = np.array(self.a.encode_ordinary(u), "<i4").tobytes(), y

    def _b_units(self, units: list[str]) -> list[bytes]:
        """B puts a space before what it is given: units lose theirs, and the new one is cut off
        before a newline."""
        got = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1) if units else []
        out = []
        for u, ids in zip(units, got):
            ids = [self.space] if u == " " else ids if u[0] == " " else ids[1:]
            out.append(np.array(ids, "<i4").tobytes())
        return out

    def tokens(self, units: list[str]) -> tuple[list[bytes], list[bytes]]:
        self._learn([u for u in units if u not in self.memo])
        memo, older = self.memo, self.older  # units known before may have grown old meanwhile
        both = [memo[u] if u in memo else older[u] for u in units]
        return [x for x, _ in both], [y for _, y in both]


@lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str) -> Pair:
    """One pair of vocabularies per Python worker."""
    pair = Pair(a_path, b_path)
    give_back()
    return pair


def _forget() -> None:
    """Workers that only look counts up need no vocabularies."""
    if _pair.cache_info().currsize:
        _pair.cache_clear()
        give_back()


def _units(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of the units of all texts in order, the distinct units, and each text's offset."""
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    coded = split.flatten().dictionary_encode()
    at, offsets = coded.indices.to_numpy().astype(np.int32), split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    parts = coded.dictionary.to_pylist()
    # a part that is empty or ends in white space has no border behind it: such texts are cut by rule
    loose = np.fromiter((not p or p[-1].isspace() or p[0] == "\n" and p[1:2].isspace() for p in parts), bool, len(parts))
    units = [p if p[:1] == "\n" else " " + p for p in parts]
    odd = np.unique(np.searchsorted(offsets, np.flatnonzero(loose[at]), "right") - 1) if loose.any() else []
    if len(odd):
        known = {u: i for i, u in enumerate(units)}
        rows, done = [], 0
        for i, text in zip(odd.tolist(), texts.take(pa.array(odd)).to_pylist()):
            rows.append(at[offsets[done]:offsets[i]])
            own = BORDER.split(" " + text)
            rows.append(np.array([known.setdefault(u, len(known)) for u in own], np.int32))
            done = i + 1
        rows.append(at[offsets[done]:])
        size = np.diff(offsets)
        size[odd] = [len(r) for r in rows[1::2]]
        at, offsets, units = np.concatenate(rows), np.concatenate([[0], np.cumsum(size)]), list(known)
        used, at = np.unique(at, return_inverse=True)
        at, units = at.astype(np.int32), [units[i] for i in used.tolist()]
    return at, units, offsets


def _kept(flat: list[bytes], names: list[bytes], sizes: np.ndarray, units: list[bytes]) -> np.ndarray:
    """Which units the tokens give back byte by byte."""
    ids = np.frombuffer(b"".join(flat), "<i4")
    if b"".join([names[i] for i in ids.tolist()]) == b"".join(units):
        ends = np.cumsum(sizes[ids])
        last = np.cumsum([len(f) // 4 for f in flat])
        if np.array_equal(ends[last - 1], np.cumsum([len(u) for u in units])):
            return np.ones(len(units), bool)
    return np.array([b"".join([names[i] for i in np.frombuffer(f, "<i4").tolist()]) == u
                     for f, u in zip(flat, units)], bool)


def _converge(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The terminal token (a number of A's) of each token, A's first, by successor doubling."""
    n = len(a_end)
    to_b = np.searchsorted(b_end, a_end)  # the token of the other side that holds the last byte
    succ = np.concatenate([np.where(b_end[to_b] > a_end, n + to_b, np.arange(n)), np.searchsorted(a_end, b_end)])
    while True:
        far = succ[succ]
        if np.array_equal(far, succ):
            return succ
        succ = far


class Aligned:
    """Tokens, groups and links of distinct units."""

    def __init__(self, pair: Pair, units: list[str]) -> None:
        a, b = pair.tokens(units)
        raw = [u.encode() for u in units]
        self.good = _kept(a, pair.a_bytes, pair.a_size, raw) & _kept(b, pair.b_bytes, pair.b_size, raw)
        if not self.good.all():
            a, b = ([x if g else b"" for x, g in zip(f, self.good.tolist())] for f in (a, b))
        self.n_a, self.n_b = (np.fromiter(map(len, f), np.int64, len(f)) // 4 for f in (a, b))
        ida, idb = (np.frombuffer(b"".join(f), "<i4").astype(np.int64) for f in (a, b))
        a_end, b_end = np.cumsum(pair.a_size[ida]), np.cumsum(pair.b_size[idb])
        unit_a = np.repeat(np.arange(len(units)), self.n_a)
        ends = np.union1d(a_end, b_end)
        self.link_unit = unit_a[np.searchsorted(a_end, ends)]
        self.n_links = np.bincount(self.link_unit, minlength=len(units))
        links = (ida[np.searchsorted(a_end, ends)] << SHIFT) | idb[np.searchsorted(b_end, ends)]
        self.pairs, self.link = np.unique(links, return_inverse=True)
        last = _converge(a_end, b_end) if len(ida) else np.zeros(0, np.int64)
        groups = np.flatnonzero(last[:len(ida)] == np.arange(len(ida)))  # terminal tokens
        self.n_groups = np.bincount(unit_a[groups], minlength=len(units))
        self.strings = self._strings(pair, ida, idb, np.searchsorted(groups, last), unit_a, len(groups))

    def _strings(self, pair: Pair, ida, idb, group, unit_a, n: int) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each unit."""
        na = len(ida)
        ga, gb = group[:na], group[na:]
        first_a, first_b = (np.searchsorted(g, np.arange(n + 1)) for g in (ga, gb))
        kind_a, kind_b = np.full(na, 2), np.full(len(idb), 2)
        kind_a[first_a[:-1]], kind_b[first_b[:-1]] = 1, 3
        kind_a[np.flatnonzero(np.diff(unit_a, prepend=-1))] = 0
        word = np.empty(na + len(idb), np.int64)
        word[np.arange(na) + first_b[ga]] = kind_a * pair.per_kind + ida
        word[np.arange(len(idb)) + first_a[gb + 1]] = kind_b * pair.per_kind + idb
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), pair.words.take(pa.array(word))), "")


BATCHES = "batch string, pairs array<long>, pair_n array<long>, body binary"
BODY = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "doc_units", "units", "unit_links", "links")
ROW_GROUPS = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}


def _packed(row: dict) -> bytes:
    """Arrays of different lengths as one value: Arrow's stream of a row of lists."""
    cols = [row[k] if isinstance(row[k], pa.Array) else pa.array(row[k]) for k in BODY]
    lists = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols], names=list(BODY))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, lists.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(lists)
    return out.getvalue().to_pybytes()


def _unpacked(body: pa.BinaryScalar) -> dict[str, pa.Array]:
    lists = pa.ipc.open_stream(body.as_buffer()).read_next_batch()
    return {k: lists.column(k)[0].values for k in BODY}


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold all of them."""
    return x.astype(np.min_scalar_type(x.max(initial=0)))


def _batch_row(b: pa.RecordBatch, pair: Pair) -> dict:
    texts = b.column("text")
    at, units, offsets = _units(texts)
    al = Aligned(pair, units)
    n = b.num_rows
    doc = np.repeat(np.arange(n), np.diff(offsets))
    good = np.bincount(doc, ~al.good[at], n) == 0
    good &= pc.binary_length(texts).to_numpy() > 0
    keep = good[doc]
    at, doc = at[keep], doc[keep]
    size = np.bincount(doc, minlength=n)
    ends = np.cumsum(size)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                                   al.strings.take(pa.array(at))), ";")
    raw, cut = memoryview(text.buffers()[2] or b""), np.frombuffer(text.buffers()[1], np.int32, n + 1, 4 * text.offset)
    sha = [hashlib.sha256(raw[x:y]).hexdigest() if g else "" for x, y, g in zip(cut[:-1].tolist(), cut[1:].tolist(), good.tolist())]
    times = np.bincount(at, minlength=len(units))
    row = {x: np.bincount(doc, getattr(al, x)[at], n).astype(np.int64) for x in ("n_a", "n_b", "n_groups", "n_links")}
    row |= {"doc_id": b.column("doc_id"), "sha": pa.array(sha, pa.string()), "doc_units": _small(size), "units": _small(at),
            "unit_links": _small(al.n_links), "links": _small(al.link)}
    return {"pairs": al.pairs, "pair_n": np.bincount(al.link, times[al.link_unit], len(al.pairs)).astype(np.int64),
            "body": _packed(row)}


def aligned_batches(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a batch of documents (``BATCHES``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for b in pieces(batches, "text", 1 << 20, 10_000):
            row = _batch_row(b, pair)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (row["pairs"], row["pair_n"])]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, pa.array([row["body"]], pa.binary())],
                                             names=["batch", "pairs", "pair_n", "body"])
        pair.older, pair.memo = {}, {}
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, BATCHES)


def pair_counts(batches: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """pair, n (links in all documents), best (whether n is the highest of its id of B)."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums within the task, of at most ``flush`` numbers and a batch's."""
        keys, ns = [], []

        def total() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(ns), len(k)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in total()], names=["pair", "n"])

        for part in parts:
            for i in range(part.num_rows):
                keys.append(part.column("pairs")[i].values.to_numpy())
                ns.append(part.column("pair_n")[i].values.to_numpy())
                if sum(map(len, keys)) > flush:
                    k, n = total()
                    keys, ns = [k], [n]
                    if len(k) > flush // 2:
                        yield out()
                        keys, ns = [], []
        if keys:
            yield out()

    counts = batches.select("pairs", "pair_n").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    top = Window.partitionBy("b")  # at most one row per id of A
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(top)).alias("best"))


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def _finish(body: pa.BinaryScalar, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The documents of a batch, from the counts of its pairs."""
    row, sums = _unpacked(body), []
    units, link = (row[k].to_numpy() for k in ("units", "links"))
    unit_cuts, doc_cuts = (np.concatenate([[0], np.cumsum(row[k].to_numpy(), dtype=np.int64)]) for k in ("unit_links", "doc_units"))
    for x in (best, n):
        upto = np.concatenate([[0], np.cumsum(x[link])])[unit_cuts]
        upto = np.concatenate([[0], np.cumsum(np.diff(upto)[units])])[doc_cuts]
        sums.append(pa.array(np.diff(upto).astype(np.int64)))
    same = [row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.RecordBatch.from_arrays([*same, *sums, row["sha"]], names=[f.split()[0] for f in RESULT.split(", ")])


MOST_BROADCAST = 4_000_000  # rows of 17 bytes


def align(docs: DataFrame, a_path: str, b_path: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    batches = stash(aligned_batches(docs, a_path, b_path), "aligned", ROW_GROUPS)
    counts = stash(pair_counts(batches), "pairs")
    if counts.count() <= most_broadcast:
        got = counts.toArrow()
        order = np.argsort(got["pair"].to_numpy())
        table = tuple(got[c].to_numpy()[order] for c in ("pair", "n", "best"))
        shared = docs.sparkSession.sparkContext.broadcast(table)
        drop_stash(counts)

        def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _forget()
            pair, n, best = shared.value
            for part in parts:
                for i in range(part.num_rows):
                    at = np.searchsorted(pair, part.column("pairs")[i].values.to_numpy())
                    yield _finish(part.column("body")[i], n[at], best[at].astype(np.int64))
            give_back()

        return batches.select("pairs", "body").mapInArrow(look_up, RESULT)
    own = batches.select("batch", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
    own = own.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("c"))  # a batch's pairs
    own = own.select("batch", F.col("c.n").alias("c_n"), F.transform("c.best", lambda x: x.cast("long")).alias("c_best"))

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        none = np.zeros(0, np.int64)
        for part in parts:
            for i in range(part.num_rows):
                c = [part.column(x)[i].values for x in ("c_n", "c_best")]
                yield _finish(part.column("body")[i], *(none if x is None else x.to_numpy() for x in c))
        give_back()

    return batches.select("batch", "body").join(own, "batch", "left").mapInArrow(joined, RESULT)


def q_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))
