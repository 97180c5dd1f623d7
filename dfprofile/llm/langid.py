"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in runs: the bytes between white space, in stretches of ``RUN`` bytes at most.  Two
GRUs, one from each end, read a run; every byte position gets a probability for each language from
both states.  A document's score for a language is the sum of the log probabilities of all its
positions in runs with a letter; the highest wins, and its mean probability is the score given.
Equal runs have equal labels, so a task labels each distinct run of a batch once.

The network is trained here, in numpy by backpropagation through time, on a bounded sample: up to
``max_docs`` different texts a language and ``max_runs`` of their runs, by hash order.  Hashes beyond what a
language's count of texts makes enough are left out where they are read, so no task ranks more than a few
texts more than ``max_docs``.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all texts if
nothing can be learned; repeated rows are labelled alike; an empty table gives no rows; other columns
are ignored; a null id counts as the empty text when folds are dealt; ties go to the first language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dfprofile.llm.common import load, pieces

RUN = 24
HIDDEN = 12


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """One direction.  ``E`` holds each byte's input to the gates (update, reset, candidate)."""

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        self.p = {"E": rng.normal(0, 0.3, (256, 3 * hidden)), "U": rng.normal(0, hidden ** -0.5, (hidden, 2 * hidden)),
                  "C": rng.normal(0, hidden ** -0.5, (hidden, hidden))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.h = hidden

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, rows, hidden) behind each byte of ``x`` (rows, steps)."""
        h, n = np.zeros((len(x), self.h), np.float32), self.h
        out, tape = np.empty((x.shape[1], len(x), n), np.float32), []
        for t in range(x.shape[1]):
            a = self.p["E"][x[:, t]]
            g = _sigmoid(a[:, :2 * n] + h @ self.p["U"])
            z, r = g[:, :n], g[:, n:]
            c = np.tanh(a[:, 2 * n:] + (r * h) @ self.p["C"])
            tape.append((h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out, tape

    def backward(self, x: np.ndarray, tape: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros((len(x), self.h), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, c = tape[t]
            dh = dh + d_out[t]
            da_c = dh * z * (1 - c * c)
            d_rh = da_c @ self.p["C"].T
            da = np.concatenate([dh * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
            grad["C"] += (r * h).T @ da_c
            grad["U"] += h.T @ da
            np.add.at(grad["E"], x[:, t], np.concatenate([da, da_c], 1))
            dh = dh * (1 - z) + d_rh * r + da @ self.p["U"].T
        return grad


class Network:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.one, self.two = labels, Gru(rng, hidden), Gru(rng, hidden)
        self.out = {"W": rng.normal(0, 0.1, (2 * hidden, len(labels))).astype(np.float32),
                    "b": np.zeros(len(labels), np.float32)}

    def _states(self, x: np.ndarray) -> tuple[np.ndarray, list, list]:
        a, tape_a = self.one.forward(x)
        b, tape_b = self.two.forward(x[:, ::-1])
        return np.concatenate([a, b[::-1]], 2), tape_a, tape_b

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """(steps, rows, labels) of equally long runs (rows, steps)."""
        s, _, _ = self._states(x)
        y = s @ self.out["W"] + self.out["b"]
        y -= y.max(2, keepdims=True)
        return y - np.log(np.exp(y).sum(2, keepdims=True))

    def gradient(self, x: np.ndarray, label: np.ndarray) -> list[tuple[dict, dict]]:
        s, tape_a, tape_b = self._states(x)
        y = s @ self.out["W"] + self.out["b"]
        p = np.exp(y - y.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(x)), label] -= 1  # every position bears the run's label
        p /= x.size
        n = self.one.h
        d = p @ self.out["W"].T
        top = {"W": np.einsum("tnh,tnc->hc", s, p), "b": p.sum((0, 1))}
        return [(self.out, top), (self.one.p, self.one.backward(x, tape_a, d[:, :, :n])),
                (self.two.p, self.two.backward(x[:, ::-1], tape_b, d[::-1, :, n:]))]

    def fit(self, runs: list[bytes], label: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.01) -> None:
        rng, by_size = np.random.default_rng(1), {}
        for i, r in enumerate(runs):
            by_size.setdefault(len(r), []).append(i)
        moments: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        step = 0
        for _ in range(epochs):
            parts = []
            for own in by_size.values():
                own = rng.permutation(own)
                parts += [own[i:i + batch] for i in range(0, len(own), batch)]
            for k in rng.permutation(len(parts)):
                x = np.frombuffer(b"".join(runs[i] for i in parts[k]), np.uint8).reshape(len(parts[k]), -1)
                step += 1
                for values, grads in self.gradient(x, label[parts[k]]):
                    for name, g in grads.items():
                        w = values[name]
                        m, v = moments.setdefault(id(w), (np.zeros_like(w), np.zeros_like(w)))
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    def run_scores(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the positions of each run: log probabilities and probabilities."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        logs = np.zeros((len(runs), len(self.labels)))
        probs = np.zeros_like(logs)
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            for part in np.array_split(own, -(-len(own) // 8192)):
                x = np.frombuffer(b"".join([runs[i] for i in part]), np.uint8).reshape(len(part), n)
                lp = self.log_probs(x)
                logs[part], probs[part] = lp.sum(0), np.exp(lp).sum(0)
        return logs, probs


def _has_letter(run: bytes) -> bool:
    return any(map(str.isalpha, run.decode("utf-8", "ignore")))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, max_docs: int = 400, max_runs: int = 8000) -> Network | None:
    """Fit on up to ``max_runs`` runs a language, from up to ``max_docs`` different texts a language."""
    def first(key: str) -> Column:
        return F.row_number().over(Window.partitionBy("lang").orderBy(key))

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    known = known.withColumn("k", F.xxhash64("text"))
    texts = known.groupBy("lang").agg(F.approx_count_distinct("k").alias("texts"))
    # the lowest hashes: 25 standard deviations above max_docs of them, so enough are left
    enough = max_docs + 25 * max_docs ** 0.5 + 100
    known = (known.join(F.broadcast(texts), "lang").where(F.col("k") / 2.0 ** 64 + 0.5 <= enough / F.col("texts"))
             .groupBy("lang", "k").agg(F.first("text").alias("text"))
             .withColumn("r", first("k")).where(F.col("r") <= max_docs))
    runs = known.select("lang", F.explode(F.split("text", r"[\s]+")).alias("run")).where(F.col("run").rlike(r"\p{L}"))
    runs = runs.select("lang", F.col("run").cast("binary").alias("run"))
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("run") - 1) / RUN).cast("int"))  # as predict() reads them
    stretches = F.transform(starts, lambda i: F.col("run").substr(i * RUN + 1, F.lit(RUN)))
    runs = runs.select("lang", F.explode(stretches).alias("run")).groupBy("lang", "run").count()
    runs = runs.withColumn("k", F.xxhash64("run", "lang")).withColumn("r", first("k")).where(F.col("r") <= max_runs)
    rows = sorted((r[0], bytes(r[1])) for r in runs.select("lang", "run").collect())  # max_runs a language
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    net = Network(labels)
    net.fit([r[1] for r in rows], np.array([labels.index(r[0]) for r in rows]))
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.coalesce("text", F.lit("")).alias("text"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(net)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in pieces(batches, "text", 8 << 20, 10_000):
            split = pc.ascii_split_whitespace(b.column("text"))
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.binary()).to_pylist()
            parts, owner = [], []
            for i, w in enumerate(words):
                if _has_letter(w):
                    for a in range(0, len(w), RUN):
                        parts.append(w[a:a + RUN])
                        owner.append(i)
            logs, probs = (np.zeros((len(words), len(net.labels))) for _ in range(2))
            for sums, part in zip((logs, probs), net.run_scores(parts)):
                np.add.at(sums, np.array(owner, np.int64), part)
            at, doc = coded.indices.to_numpy(), split.offsets.to_numpy()
            n = b.num_rows
            doc = np.repeat(np.arange(n), np.diff(doc))
            total = np.stack([np.bincount(doc, logs[at, c], n) for c in range(len(net.labels))], 1)
            mass = np.stack([np.bincount(doc, probs[at, c], n) for c in range(len(net.labels))], 1)
            best, size = total.argmax(1), mass.sum(1)
            score = np.where(size > 0, mass[np.arange(n), best] / np.maximum(size, 1e-9), 0.0)
            names = [net.labels[k] if s > 0 else "und" for k, s in zip(best.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(label, schema)


def q_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return predict(docs, train(docs))
