"""Removal of repeated byte strings, by doubled hashes at window minima.

The identifier of a string is a 64-bit hash that follows from its bytes alone: identifiers of single
bytes are combined to those of 2, 4, ... bytes, that of 2k bytes at p from those of k bytes at p and
at p + k.  Positions with one identifier of 200 bytes start equal strings.  This is not the
bucket-pointer refinement of suffixes: no bucket is refined by sorting on the buckets of later
offsets, and levels are not kept from one step to the next.

1. Buckets are those of 64-byte strings, entered only at the positions that are the first least (by
   identifier) in some 200-byte window; equal windows have it at the same place.
   Buckets with one position leave: no window around it repeats.
2. Around each position left, the windows for which it is the least get their identifiers anew from
   single bytes and are sorted on them once; windows with an identifier that two positions have
   repeat.  Buckets of very common strings are not gathered but counted window by window,
   pre-aggregated.

Equal texts are one node; each of them, of 200 bytes or more, is a repeat as a whole.

Defined results: null text is empty; matches never cross documents; texts shorter than the window
lose nothing; repeated rows are repeats of each other; an empty table gives no rows; other columns
are ignored.  Removed runs that touch are one span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dfprofile.llm.common import checked, cut, drop_stash, fresh, give_back, load, pieces, stash, text_bytes

WINDOW = 200
GRAM = 64  # length of the initial buckets' strings
HOT = 50_000  # positions up to which a bucket is refined in one task (some 15 MB)
SEGMENT = 1 << 20  # bytes handled at once
BYTE_IDS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of two strings in a row."""
    x = a * C1
    x += b * C2
    x ^= x >> np.uint64(32)
    x *= C3
    x ^= x >> np.uint64(29)
    return x


def identifiers(ids: np.ndarray, size: int, length: int) -> np.ndarray:
    """From identifiers of ``size`` bytes at each position to those of ``length`` bytes."""
    while 2 * size <= length:
        ids = _join(ids[:-size], ids[size:])
        size *= 2
    return _join(ids[:size - length], ids[length - size:]) if size < length else ids


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or largest of each ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:size - width], x[width - size:]) if size < width else x


def _segments(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, whether a window may start at each position, and text number and offset of each
    stretch's start, packed from whole texts or overlapping stretches of long ones."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def out():
        buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        valid = np.ones(len(buf) - window + 1, bool)
        for e in ends[:-1]:
            valid[max(0, e - window + 1):e] = False
        return buf, valid, np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), ends - sizes

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - window + 1), SEGMENT):
            part = t[at:at + SEGMENT + window - 1]
            if len(part) < window:
                continue
            if parts and held + len(part) > SEGMENT:
                yield out()
                parts, held = [], 0
            parts.append((i, at, part))
            held += len(part)
    if parts:
        yield out()


def owners(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple]:
    """Of texts packed together: text number, position and identifier of each string that is the
    first least one of some windows, and the start of the first and last such window (in a row)."""
    width, low = window - gram + 1, np.uint64((1 << 32) - 1)
    for buf, valid, text, offset, start in _segments(texts, window):
        ids = identifiers(BYTE_IDS[buf], 1, gram)
        order = (ids & ~low) | np.arange(len(ids), dtype=np.uint64)
        at = np.flatnonzero(valid)
        own = (_extreme(order, width, np.minimum)[at] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(at) != 1)]))
        first, last, own = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], own[new]
        part = np.searchsorted(start, own, "right") - 1
        shift = offset[part] - start[part]
        yield text[part], own + shift, ids[own], first + shift, last + shift


def _runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Union of windows at sorted ``starts``."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(g[0]), int(g[-1]) + window) for g in np.split(starts, cuts)]


def _positions(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in this task enter once
        for b in pieces(batches, "text", 2 << 20):
            nodes, texts = [], []
            for node, t in zip(b.column("node").to_pylist(), b.column("text").to_pylist()):
                if len(t) >= window and node not in seen:
                    if len(seen) < 1 << 17:
                        seen.add(node)
                    nodes.append(node)
                    texts.append(t)
            nodes = np.array(nodes, np.int64)
            for doc, pos, ids, _, _ in owners(texts, window, gram):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids.view(np.int64), nodes[doc], pos)],
                                                 names=["key", "node", "pos"])

    return docs.select("node", "text").mapInArrow(enter, "key long, node long, pos long")


def _contexts(docs: DataFrame, reps: DataFrame, marks: DataFrame, window: int, gram: int) -> DataFrame:
    """key, node, start, bytes of the windows around marked positions (key, node, pos); one
    document stands for a node (more where an id repeats)."""
    per_node = marks.groupBy("node").agg(F.collect_set("pos").alias("at"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            texts, at, nodes = b.column("text").to_pylist(), b.column("at"), b.column("node").to_numpy()
            marked = (np.repeat(np.arange(len(texts)), np.diff(at.offsets.to_numpy())) << 40) | at.flatten().to_numpy()
            for doc, pos, ids, first, last in owners(texts, window, gram):
                hit = np.flatnonzero(np.isin((doc.astype(np.int64) << 40) | pos, marked))
                doc, first, last = doc[hit], first[hit], last[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit].view(np.int64)), pa.array(nodes[doc]), pa.array(first),
                     pa.array([texts[i][lo:hi + window] for i, lo, hi in zip(doc.tolist(), first.tolist(), last.tolist())],
                              pa.binary())], names=["key", "node", "start", "bytes"])

    nodes = checked(marks.select("node").distinct().join(reps, "node").select(F.col("node").alias("own"), "rep"))
    texts = docs.join(nodes, (F.col("node") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    return texts.join(per_node, "node").select("node", "text", "at").mapInArrow(
        cut_out, "key long, node long, start long, bytes binary")


def _refine(contexts: DataFrame, window: int) -> DataFrame:
    """node, lo, hi of repeated strings, whole buckets in a task."""

    def repeated(pool: list[tuple[bytes, tuple | None]]) -> list[tuple[int, int, int]]:
        """Runs of the strings of one row each (node, start) that repeat in any string."""
        buf = np.frombuffer(b"".join(p[0] for p in pool), np.uint8)
        n = np.array([len(p[0]) for p in pool])
        begin, count = np.cumsum(n) - n, n - window + 1
        row = np.repeat(np.arange(len(pool)), count)
        off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        ids = identifiers(BYTE_IDS[buf], 1, window)[begin[row] + off]
        order = np.argsort(ids)
        same = np.diff(ids[order]) == 0
        hit = np.zeros(len(ids), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        hit = np.flatnonzero(hit & np.array([p[1] is not None for p in pool])[row])
        out = []
        if len(hit):
            row, off = row[hit], off[hit]
            for g in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(row)) + 1):
                node, start = pool[row[g[0]]][1]
                out += [(node, lo, hi) for lo, hi in _runs(start + off[g], window)]
        return out

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[tuple[bytes, tuple | None]] = []
        found: list[tuple[int, int, int]] = []
        bucket: dict[bytes, list[tuple]] = {}
        size, last, key = 0, None, None

        def close() -> None:
            """Strings that occur twice repeat as a whole; others are compared with all strings."""
            nonlocal size
            if len(bucket) == 1 and len(next(iter(bucket.values()))) == 1:
                return
            alone = any(len(rows) == 1 for rows in bucket.values())
            for text, rows in bucket.items():
                if len(rows) > 1:
                    found.extend((node, start, start + len(text)) for node, start in rows)
                if alone:
                    pool.append((text, rows[0] if len(rows) == 1 else None))
                    size += len(text)

        def out() -> pa.RecordBatch:
            rows = found + (repeated(pool) if pool else [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [[]] * 3],
                                              names=["node", "lo", "hi"])

        for b in batches:
            for k, node, start, text in zip(*(b.column(c).to_pylist() for c in ("key", "node", "start", "bytes"))):
                if k != key:
                    close()
                    bucket, key, last = {}, k, None
                    if size > 1 << 20 or len(found) > 100_000:
                        yield out()
                        pool, found, size = [], [], 0
                if (node, start) != last:  # else a row with the same id and text
                    last = node, start
                    bucket.setdefault(text, []).append(last)
        close()
        yield out()
        give_back()

    return (contexts.repartition("key").sortWithinPartitions("key", "node", "start")
            .mapInArrow(refine, "node long, lo long, hi long"))


def _count(contexts: DataFrame, window: int) -> DataFrame:
    """The same for buckets of any size: windows counted by identifier, pre-aggregated."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, start, text in zip(*(b.column(c).to_pylist() for c in ("node", "start", "bytes"))):
                ids = identifiers(BYTE_IDS[np.frombuffer(text, np.uint8)], 1, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.view(np.int64)), pa.array(np.full(len(ids), node)),
                     pa.array(start + np.arange(len(ids)))], names=["id", "node", "lo"])

    rows = cut(contexts.mapInArrow(windows, "id long, node long, lo long"))
    again = (rows.groupBy("id").agg(F.min("node").alias("n0"), F.max("node").alias("n1"),
                                    F.min("lo").alias("l0"), F.max("lo").alias("l1"))
             .where("n0 <> n1 or l0 <> l1").select("id"))
    return rows.join(again, "id").select("node", "lo", (F.col("lo") + window).alias("hi")).distinct()


def repeated_runs(docs: DataFrame, reps: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """node, runs (array of lo, hi) of texts that hold a string of ``window`` bytes which starts
    anywhere else too; ``docs``: node (of the text), text (binary), doc_id; ``reps``: node, rep (the
    id of one of its documents)."""
    table = stash(_positions(docs, window, gram), "positions")
    buckets = table.groupBy("key").agg(
        F.min("node").alias("n0"), F.max("node").alias("n1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"),
        F.count(F.lit(1)).alias("c")).where("n0 <> n1 or p0 <> p1").select("key", (F.col("c") > hot).alias("hot"))
    marks = cut(table.join(buckets, "key"))
    drop_stash(table)
    found = _refine(_contexts(docs, reps, marks.where("not hot"), window, gram), window)
    if marks.where("hot").limit(1).count():
        found = found.union(_count(_contexts(docs, reps, marks.where("hot"), window, gram), window))
    return found.groupBy("node").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def _union(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _left(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    return b"".join([*kept, text[at:]])


def _nodes(docs: DataFrame) -> DataFrame:
    """Add node (a hash of the text that no other text has) and bytes."""
    bytes_ = text_bytes()
    for seed in range(16):
        node = F.xxhash64(F.lit(seed), F.md5(bytes_))
        pairs = docs.select(node.alias("node"), F.md5(bytes_).alias("digest"))
        clash = pairs.groupBy("node").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
        if not clash.limit(1).count():
            break
    else:
        raise ValueError("different texts share a name under every seed")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"), bytes_.alias("text"),
                       F.md5(bytes_).alias("mark"))


def _analysed(docs: DataFrame, window: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with nodes; light rows (doc_id, node, n_bytes, copies, sha); runs by node."""
    rows = _nodes(docs)
    light = cut(rows.select("doc_id", "node", "mark", F.octet_length("text").cast("long").alias("n_bytes"),
                            F.sha2("text", 256).alias("sha")))
    copies = cut(light.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep")))
    runs = cut(repeated_runs(rows, copies.select("node", "rep"), window, gram, hot))
    return rows, light.join(copies.select("node", "copies"), "node"), runs


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows, light, runs = _analysed(docs, window, gram, hot)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            out = []
            for node, t, r in zip(*(b.column(c).to_pylist() for c in ("node", "text", "runs"))):
                r = _union(r)
                out.append((node, sum(hi - lo for lo, hi in r), len(r), hashlib.sha256(_left(t, r)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, [*[pa.int64()] * 3, pa.string()])],
                names=["node", "n", "spans", "left"])

    single = cut(runs.join(light.where("copies = 1").select("node"), "node", "left_semi"))
    some = rows.select("node", "text").join(checked(single.select("node")), "node", "left_semi")
    cut_rows = some.join(single, "node").mapInArrow(remove, "node long, n long, spans long, left string")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    zero = F.lit(0).cast("long")
    return light.join(cut_rows, "node", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` without repeated strings in ``text`` (characters cut in part go as a
    whole); ``n_chars``, where there is one, follows.  A text that goes as a whole is left empty."""
    from pyspark.sql.types import StringType

    rows, light, runs = _analysed(docs, window, gram, hot)
    whole = light.where((F.col("copies") > 1) & (F.col("n_bytes") >= window)).select(
        "node", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi"))).alias("runs"))
    runs = cut(runs.join(whole, "node", "left_anti").union(whole.dropDuplicates(["node"])))
    mark, node, at = fresh(docs, "mark_", "node_", "runs_")
    docs = docs.withColumn(mark, F.md5(text_bytes()))
    table = runs.join(light.select("node", "mark").distinct(), "node").select(
        F.col("mark").alias(node), F.col("runs").alias(at))
    names = checked(table.select(node))
    same = F.col(mark) == F.col(node)

    @F.pandas_udf(StringType())
    def strip(text, runs):
        return text.combine(runs, lambda t, r: _left(t.encode(), _union(list(r))).decode(errors="ignore"))

    changed = docs.join(names, same, "left_semi").join(table, same).withColumn(
        "text", strip(F.coalesce("text", F.lit("")), at))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != mark]
    return docs.join(names, same, "left_anti").select(*keep).unionByName(changed.select(*keep))


def q_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(load(spark, sf_dir, "documents"))
