"""Benchmark decontamination: CGK random walks, bit-sampling LSH, exact edit verification.

Words are runs of letters and digits, lower-cased.  A CGK walk reads a window of words with a pointer
that stays or moves by a random bit of (step, word), so it maps edit distance to Hamming distance:
walks over windows that differ by few edits fall in step again.  An LSH key is a sample of the
walk's steps.

Items are dealt to tables by their size, and a table's walks end after as many words as any match
of its items must hold unedited in a row: k edits cut an item of m words into k + 1 stretches, of
which one has (m - k) / (k + 1) words or more (at 20 %: four words of nearly every item of 12 words
or more, two or three of shorter ones, all of those of up to four).  Windows start at every word of
items and documents, so the windows of that stretch are the same words and have the same key: each
match within the limit meets the index, and no repetitions with other walks are needed.

A collision proposes an alignment; the whole item is then compared with that stretch of the document
by exact edit distance over words (the item's ends are fixed, the stretch's are free), and a document
is contaminated if distance <= (1 - similarity) * item's words, rounded down.

Items are broadcast if they have ``MOST_WORDS`` words or fewer; a larger benchmark is dealt into
parts of that size, each searched in a pass of its own.

Defined results: null and empty texts match nothing, nor do items without words; repeated rows each
give rows; empty tables give no rows; other columns are ignored; of several places of an item in a
document the closest, then the first, is given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dfprofile.llm.common import checked, cut, fresh, give_back, load, pieces, text_bytes

MOST_WORDS = 2_000_000
LONGEST = 8  # words of a window, at most
STEPS = 3  # of a walk, for each word of its window
SAMPLE = 0.8  # share of the steps in a key
MOST_HITS = 1 << 20  # collisions held at once, about
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Letters and digits stay (upper case lowered, bytes of other scripts too), all else is a border.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts in a row, and each text's first word."""
    joined = pa.array([t.translate(WORD_BYTES) for t in texts], pa.binary())
    split = pc.ascii_split_whitespace(joined.view(pa.string()))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    full = np.array([bool(w) for w in words], bool)[coded.indices.to_numpy()]
    rows = split.offsets.to_numpy()
    rows = np.concatenate([[0], np.cumsum(full)])[rows - rows[0]]
    return h[coded.indices.to_numpy()[full]], rows


def most_edits(size: int, similarity: float) -> int:
    """Edits allowed in an item of ``size`` words."""
    return int((1 - similarity) * size + 1e-9)


def window(size: int, similarity: float) -> int:
    """Words that any match of an item of ``size`` words holds unedited in a row."""
    edits = most_edits(size, similarity)
    return max(1, min(LONGEST, -(-(size - edits) // (edits + 1))))


def walk_keys(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """LSH key of the walk over the ``width`` words from each of ``starts``; a walk that has passed
    them stays behind them and reads nothing."""
    rng = np.random.default_rng(1000 + width)
    sampled = set(rng.permutation(STEPS * width)[:round(SAMPLE * STEPS * width)].tolist())
    padded = np.append(words, np.uint64(0))
    bits, one = K1 + np.uint64(2 * width), np.uint64(1)
    at, end, key = starts.copy(), starts + width, np.full(len(starts), width, np.uint64)
    for step in range(STEPS * width):
        here = padded.take(at)
        here *= at < end
        if step in sampled:
            key ^= here
            key *= K2
            key ^= key >> np.uint64(29)
        here *= bits  # a word's random bits, one for each step
        here >>= np.uint64(17 + step)
        here &= one
        at += here.view(np.int64)
    return key


class Index:
    """LSH tables over all windows of the items, by the width of the windows."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float) -> None:
        self.ids = [i for i, _ in items]
        self.words, self.rows = _words([t for _, t in items])
        size = np.diff(self.rows)
        self.item = np.repeat(np.arange(len(items)), size)
        width = np.array([window(n, similarity) for n in size.tolist()], np.int64)[self.item]
        starts = np.arange(len(self.words))
        fits = starts + width <= self.rows[1:][self.item]
        self.tables = {}
        for w in np.unique(width).tolist():
            at = starts[fits & (width == w)]
            keys = walk_keys(self.words, at, w)
            order = np.argsort(keys, kind="stable")
            self.tables[w] = keys[order], at[order]

    def candidates(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (text, item, start of the item in the words of the text) that collide."""
        text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        left = rows[1:][text] - np.arange(len(words))
        found = []
        for width, (keys, at) in self.tables.items():
            starts = np.flatnonzero(left >= width)
            k = walk_keys(words, starts, width)
            lo = np.searchsorted(keys, k)
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == k)
            starts, lo = starts[hit], lo[hit]
            n = np.searchsorted(keys, k[hit], "right") - lo
            ends = np.cumsum(n)
            for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(ends // MOST_HITS)) + 1):
                m = n[some]
                place = at[np.repeat(lo[some], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                here, item = np.repeat(starts[some], m), self.item[place]
                begin = here - rows[:-1][text[here]] - (place - self.rows[:-1][item])
                found.append(np.unique(np.stack([text[here], item, begin]), axis=1))
        return np.unique(np.concatenate(found, axis=1), axis=1).T if found else np.zeros((0, 3), np.int64)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits that turn ``item`` into a stretch of ``text``, and the stretch (the first)."""
    n = len(text)
    row, begin, steps = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for i, w in enumerate(item):
        best = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        came = np.where(row[:-1] + (text != w) <= row[1:] + 1, begin[:-1], begin[1:])
        cost = np.concatenate([[i + 1], best])
        came = np.concatenate([[0], came])
        # insertions: the least of cost[j] + (k - j) over j <= k
        rank = (cost - steps) * (n + 2) + steps
        low = np.minimum.accumulate(rank)
        j = low - np.floor_divide(low, n + 2) * (n + 2)
        row, begin = cost[j] + steps - j, came[j]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


def _matches(index: Index, texts: list[bytes], similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Text number, item number, distance, first word and number of words of each match."""
    words, rows = _words(texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for text, item, at in index.candidates(words, rows).tolist():
        own = index.words[index.rows[item]:index.rows[item + 1]]
        edits = most_edits(len(own), similarity)
        if at - done.get((text, item), at - edits - 1) <= 0:
            continue  # compared already
        lo = max(0, at - 2 * edits)
        here = words[rows[text] + lo:min(rows[text + 1], rows[text] + at + len(own) + 2 * edits)]
        done[text, item] = at + edits // 2
        if np.isin(own, here).sum() < len(own) - edits:
            continue  # each word that the stretch lacks is an edit
        distance, a, b = edit_distance(own, here)
        if distance <= edits and (distance, lo + a) < best.get((text, item), (edits + 1,))[:2]:
            best[text, item] = distance, lo + a, b - a
    return [(*k, *v) for k, v in best.items()]


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, distance (words), item_words, first_word, n_words for each benchmark item
    found in a document."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"),
                                                       text_bytes().alias("text"))
    weight = (F.octet_length("text") / 2 + 1).cast("long")
    parts = max(1, -(-(items.agg(F.sum(weight)).first()[0] or 0) // MOST_WORDS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = None
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        some = [(r[0], bytes(r[1])) for r in some.collect()]  # MOST_WORDS words, about
        some = sorted((x for x in some if re.search(rb"[^ ]", x[1].translate(WORD_BYTES))), key=str)
        index = spark.sparkContext.broadcast(Index(some, similarity))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            give_back()  # what earlier stages have freed
            known = index.value
            for b in pieces(batches, "text", 1 << 20):
                found = _matches(known, b.column("text").to_pylist(), similarity) if known.ids else []
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[t], known.ids[i], d, int(known.rows[i + 1] - known.rows[i]), a, n) for t, i, d, a, n in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [[]] * 6],
                                                 names=["doc_id", "item_id", "distance", "item_words", "first_word", "n_words"])

        found = rows.mapInArrow(find, "doc_id long, item_id long, distance long, item_words long, first_word long, n_words long")
        out = found if out is None else out.union(found)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found.  Rows share their id's verdict."""
    (bad,) = fresh(docs, "bad_")
    found = checked(contamination(docs, benchmark).select(F.col("doc_id").alias(bad)).distinct())
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(bad)), "left_anti")


def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
