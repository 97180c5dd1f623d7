"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words counts their common subsequences of three letters, each occurrence weighed by
``DECAY`` to the power of its span (spans up to ``SPAN``), normalised and raised to ``POWER``; below
``LEAST`` before that it is zero.  Letters are folded (case, accents, digits and signs that look like
letters); other signs match nothing and only widen gaps, so gapped insults and ones with
inserted characters stay close to the plain word.  Words longer than ``STRETCH`` letters count as
overlapping stretches, and three or more words of one letter each are also read as one.

A sentence's features are the sums over its words of the kernel with each landmark, mapped by the
inverse root of the landmarks' own kernel (Nyström).  Landmarks are words that go with the label,
counted by grouping over the labelled sample; they are taken as long as they tell apart documents that
the earlier ones leave open.  Labels belong to documents, so the machine is trained in
rounds: a toxic document's witnesses are its sentences that the last round finds toxic, one at least
(at first all that are like a landmark); of others every sentence counts.  A document's score is a logistic fit over its highest sentences and their number.

The sample: up to ``max_docs`` labelled documents by hash order, one of near copies, and of each up to ``max_sentences``
sentences with the most likeness to landmarks.  Scoring reads whole texts.

Defined results: null and empty texts are one sentence without features;
null and repeated ids keep a row each, a null id counts as the empty text when folds are dealt; of a
document's differing labels the highest counts, others than 0 and 1 are left out; if nothing can be
learned all scores are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dfprofile.llm.common import load, pieces, stash

DECAY, SPAN, POWER, LEAST = 0.8, 8, 6, 0.5
STRETCH, STEP, TOP = 24, 12, 3
LETTERS = 0x370  # from here on, signs count as letters of a few classes
# Signs that look like letters.
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code of each sign below ``LETTERS``: 1 to 26 Latin letters, 27 to 31 other letters, 0 none."""
    out = np.zeros(LETTERS, np.int32)
    for i in range(LETTERS):
        c = unicodedata.normalize("NFKD", ALIKE.get(chr(i), chr(i)))[:1].lower()
        out[i] = ord(c) - 96 if "a" <= c <= "z" else 27 + i % 5 if c.isalpha() else 0
    return out


def fold(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the signs of all words in a row, and the number of the word of each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    low = np.minimum(points, LETTERS - 1)
    return np.where(points < LETTERS, _folding()[low], 27 + points % 5).astype(np.int32), np.repeat(
        np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))


def _occurrences(code: np.ndarray, word: np.ndarray, table: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Word and value of the triples with letters only (or those ``table`` holds), by span."""
    for far in range(2, min(SPAN, len(code))):
        same = word[:-far] == word[far:]
        for mid in range(1, far):
            a, b, c = code[:-far], code[mid:mid - far], code[far:]
            value = (a << 10) | (b << 5) | c
            if table is None:
                at = np.flatnonzero(same & (a > 0) & (b > 0) & (c > 0))
                yield word[at], value[at], DECAY ** (far + 1)
            else:
                slot = table[value]
                at = np.flatnonzero((slot >= 0) & same)
                yield word[at], slot[at], DECAY ** (far + 1)


def own_kernel(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself, before it is normalised."""
    got = list(_occurrences(*fold(words)))
    if not got:
        return np.zeros(len(words))
    word, value = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    key, at = np.unique((word.astype(np.int64) << 15) | value, return_inverse=True)
    sums = np.bincount(at, np.concatenate([np.full(len(g[0]), g[2]) for g in got]))
    return np.bincount(key >> 15, sums * sums, len(words))


class Landmarks:
    def __init__(self, words: list[str]) -> None:
        self.words = words
        sums: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for w, v, x in _occurrences(*fold(words)):
            for i, value in zip(w.tolist(), v.tolist()):
                sums[value][i] += x
        self.table = np.full(1 << 15, -1, np.int32)
        self.table[list(sums)] = np.arange(len(sums))
        lists = [sorted(s.items()) for s in sums.values()]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.of = np.array([i for x in lists for i, _ in x], np.int64)
        self.by = np.array([y for x in lists for _, y in x])
        self.norm = np.sqrt(own_kernel(words))

    def kernel(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, landmark and kernel wherever it is not zero."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not words or not len(self.of):
            return none
        code, word = fold(words)
        m, n = len(self.words), len(words)
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for w, slot, x in _occurrences(code, word, self.table):
            size = self.starts[slot + 1] - self.starts[slot]
            at = np.repeat(self.starts[slot] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            keys.append(np.repeat(w, size) * m + self.of[at])
            values.append(self.by[at] * x)
        raw = np.bincount(np.concatenate(keys), np.concatenate(values), n * m)
        # a word's own kernel is at least that of its neighbouring triples, each counted alone
        full = (code[:-2] > 0) & (code[1:-1] > 0) & (code[2:] > 0) & (word[:-2] == word[2:])
        least = np.maximum(np.bincount(word[:-2][full], minlength=n), 1e-9) * DECAY ** 6
        hit = np.flatnonzero(raw)
        w, k = np.divmod(hit, m)
        maybe = raw[hit] >= LEAST * np.sqrt(least)[w] * self.norm[k] * (1 - 1e-9)
        w, k, raw = w[maybe], k[maybe], raw[hit[maybe]]
        if not len(w):
            return none
        some, at = np.unique(w, return_inverse=True)
        own = np.sqrt(own_kernel([words[i] for i in some.tolist()]))
        value = raw / (own[at] * self.norm[k])
        keep = value >= LEAST
        return w[keep], k[keep], value[keep] ** POWER

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.words),) * 2)
        w, k, v = self.kernel(self.words)
        out[w, k] = v
        return out


def _stretches(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words as stretches of at most ``STRETCH`` signs, and the word of each."""
    out, of = list(words), list(range(len(words)))
    long = [i for i, n in enumerate(map(len, words)) if n > STRETCH]
    for i in long:
        w, out[i] = words[i], words[i][:STRETCH]
        for a in range(STEP, len(w) - STRETCH + STEP, STEP):
            out.append(w[a:a + STRETCH])
            of.append(i)
    return out, np.array(of)


class Sentences:
    """Words of a batch of texts: the distinct ones, which stand where, and sentences as runs."""

    def __init__(self, texts: pa.Array) -> None:
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = split.flatten().dictionary_encode()
        at, offsets = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        words = coded.dictionary.to_pylist()
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        ending = np.array([w[-1:] in ".!?" for w in words] or [False])
        single = np.zeros(max(len(words), 1), bool)
        short = np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy() <= 6)
        single[[i for i in short.tolist() if len(words[i]) <= 3 and sum(map(str.isalnum, words[i])) == 1]] = True
        begins = np.zeros(len(at), bool)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        begins[1:] |= ending[at[:-1]]
        self.sentence = np.cumsum(begins) - 1
        self.doc = doc[begins]
        # words of one letter in a row also stand as one word, with the first of them
        run = single[at] if len(at) else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], run.astype(np.int8), [0]])))
        known, far = {}, edge[1::2] - edge[::2] >= 3
        for a, b in zip(edge[::2][far].tolist(), edge[1::2][far].tolist()):
            for x, y in self._same_doc(doc, a, b):
                if y - x >= 3:
                    w = "".join(c for i in at[x:y].tolist() for c in words[i] if c.isalnum())
                    known.setdefault(w, []).append(x)
        fused = list(known)
        where = [x for w in fused for x in known[w]]
        number = [len(words) + i for i, w in enumerate(fused) for _ in known[w]]
        self.words = words + fused
        self.at = np.concatenate([at, np.array(number, np.int64)])
        self.sentence = np.concatenate([self.sentence, self.sentence[np.array(where, np.int64)]])

    @staticmethod
    def _same_doc(doc: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(doc[a:b]))).tolist(), b]
        return zip(cuts, cuts[1:])

    def kernel(self, landmarks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, of = _stretches(self.words)
        w, k, v = landmarks.kernel(parts)
        return of[w], k, v


class Model:
    """Landmarks, the machine's weight of each, and a logistic fit over a document's ``TOP`` highest
    sentences and their number."""

    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks = landmarks
        values, vectors = np.linalg.eigh(landmarks.matrix())
        keep = values > 1e-6
        self.root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström
        self.weight, self.bias, self.pool = np.zeros(len(landmarks.words)), 0.0, np.zeros(TOP + 2)

    def fit(self, bag: np.ndarray, x: np.ndarray, size: np.ndarray, y: np.ndarray, rounds: int = 6) -> None:
        """``x``: the sentences' sums, ``bag``: their documents, ``size``: sentences of each document,
        ``y``: its label; sentences that are not here have no features."""
        lacking = np.flatnonzero(size > np.bincount(bag, minlength=len(y)))
        bag = np.concatenate([bag, lacking])
        z = np.concatenate([x, np.zeros((len(lacking), x.shape[1]))]) @ self.root
        z = np.column_stack([z, np.ones(len(z))])
        score = np.concatenate([x.sum(1), np.zeros(len(lacking))])
        for _ in range(rounds):
            order = np.lexsort((np.arange(len(bag)), -score, bag))
            chosen = score > 0
            chosen[order[np.flatnonzero(np.diff(bag[order], prepend=-1))]] = True
            rows = np.flatnonzero(chosen | (y[bag] == 0))
            w = _svm(z[rows], np.where(y[bag[rows]] == 1, 1.0, -1.0))
            score = z @ w
        self.weight, self.bias = self.root @ w[:-1], float(w[-1])
        self.pool = _logistic(self._pooled(bag, z @ w, size), y)

    def _pooled(self, bag: np.ndarray, score: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each document the highest scores (that of no features where it has fewer), how many
        sentences it has, and one."""
        out = np.full((len(size), TOP), self.bias)
        order = np.lexsort((-score, bag))
        first = np.flatnonzero(np.diff(bag[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        top = rank < TOP
        out[bag[order[top]], rank[top]] = np.maximum(score[order[top]], self.bias)
        return np.column_stack([out, np.log1p(size), np.ones(len(size))])

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of the label for each text."""
        s = Sentences(texts)
        w, k, v = s.kernel(self.landmarks)
        word = np.bincount(w, v * self.weight[k], max(len(s.words), 1))
        sums = np.bincount(s.sentence, word[s.at], len(s.doc)) + self.bias
        size = np.bincount(s.doc, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self._pooled(s.doc, sums, size) @ self.pool, -30, 30)))


def _svm(z: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss and classes of equal weight, by Newton steps."""
    n, share = len(y), np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) * len(y) / 2
    flat = np.eye(z.shape[1])
    flat[-1, -1] = 1e-6  # the bias is not held back

    def loss(w: np.ndarray) -> float:
        return w @ flat @ w / 2 + cost * (share * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()

    w = np.zeros(z.shape[1])
    for _ in range(50):
        gap = 1 - y * (z @ w)
        on = gap > 0
        grad = flat @ w - 2 * cost * z[on].T @ (share[on] * y[on] * gap[on])
        step = np.linalg.solve(flat + 2 * cost * (z[on] * share[on][:, None]).T @ z[on], grad)
        t, now = 1.0, loss(w)
        while t > 1e-4 and loss(w - t * step) > now - 1e-4 * t * (grad @ step):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9 * max(n, 1) ** 0:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the probability of label 1, with the targets of Platt's method."""
    ones = y.sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    w, held = np.zeros(x.shape[1]), np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + held, x.T @ (p - goal) + held @ w)
        step /= max(1.0, np.abs(step).max())
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """One document of those whose pairs of neighbouring words have the same least hash, so that many
    copies of one document do not make all its words tell."""
    words = F.split(F.lower("text"), r"\s+")
    least = F.when(F.size("w") > 1, F.array_min(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
        lambda i: F.xxhash64(F.element_at("w", i), F.try_element_at("w", i + 1))))).otherwise(F.xxhash64("text"))
    keyed = sample.withColumn("w", words).withColumn("key", least).drop("w")
    return keyed.groupBy("key").agg(F.min_by(F.struct("id", "text", "y"), F.struct("id", "y")).alias("s")).select("s.*")


def _landmarks(sample: DataFrame, n: int, ones: int, most: int) -> list[str]:
    """Words that go with the label, by their counts in the sample's documents of either class."""
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")
    bare = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word")
    seen = sample.select("id", "y", word).select("id", "y", bare).where(F.length("word").between(3, STRETCH)).distinct()
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    mean = ones / n
    z = (F.col("ones") - F.col("n") * mean) / F.sqrt(F.col("n") * mean * (1 - mean))
    telling = counts.where((F.col("n") >= 4) & (z >= 5)).orderBy(z.desc(), "word").limit(8 * most).select("word")
    rows = seen.where("y = 1").join(F.broadcast(telling), "word").select("word", "id").collect()  # 8 * most words of the sample
    docs = defaultdict(set)
    for r in rows:
        docs[r["word"]].add(r["id"])
    met, out = Counter(), []
    while docs and len(out) < most:  # documents count less the more of their words are taken
        gain = {w: sum(1 / (1 + met[d]) for d in own) for w, own in docs.items()}
        best = max(sorted(gain), key=gain.get)
        if gain[best] < 1:
            break
        out.append(best)
        met.update(docs.pop(best))
    return out


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_sentences: int = 32, max_landmarks: int = 64) -> Model | None:
    """Fit on labelled documents outside the held-out fold; None without documents of both classes
    or words that tell them apart."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)  # the sample
    sample = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), "id")
    sample = stash(_one_of_copies(sample), "labelled")
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        return None
    landmarks = Landmarks(_landmarks(sample, n, ones, max_landmarks))
    if not len(landmarks.of):
        return None
    m = len(landmarks.words)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            s = Sentences(b.column("text"))
            w, k, v = s.kernel(landmarks)
            x = np.zeros((max(len(s.words), 1), m))
            np.add.at(x, (w, k), v)
            hit = np.flatnonzero(x.any(1)[s.at])
            own, at = np.unique(s.sentence[hit], return_inverse=True)
            total = np.zeros((len(own), m))
            np.add.at(total, at, x[s.at[hit]])
            lists = [[] for _ in range(b.num_rows)]
            for i in np.argsort(-total.sum(1), kind="stable").tolist():
                mine = lists[s.doc[own[i]]]
                if len(mine) < max_sentences:
                    mine.append(total[i].tolist())
            size = pa.array(np.bincount(s.doc, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), size, pa.array(lists, pa.list_(pa.list_(pa.float64())))],
                                             names=["id", "y", "size", "x"])

    got = sample.mapInArrow(sums, "id long, y int, size long, x array<array<double>>").collect()  # max_docs rows
    got = sorted(got)
    bag = np.array([i for i, r in enumerate(got) for _ in r["x"]], np.int64)
    x = np.array([s for r in got for s in r["x"]]).reshape(-1, m)
    y = np.array([r["y"] for r in got])
    model = Model(landmarks)
    model.fit(bag, x, np.array([r["size"] for r in got]), y)
    return model


def predict(docs: DataFrame, model: Model | None, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in pieces(batches, "text", 4 << 20, 10_000):
            p = model.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= least).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return predict(docs, train(docs, load(spark, sf_dir, "labels")))
