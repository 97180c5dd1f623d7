"""Quality and toxicity by hierarchical empirical Bayes.

Evidence of a document: two logistic models over hashed words, their punctuation and their case, fit
on a bounded sample of labelled rows (``max_rows``, by hash order).  A document's log-odds less the
sample's base rate is its own evidence.  Sites have a host (``source``) and a path (``lang``; other
columns may be named).  The documents' probabilities are summed by path and by host in grouped
aggregations; a host's rate is shrunk towards the global rate and a path's towards its host's, by
prior strengths estimated from the spread of the rates (method of moments), so sparse sites have
little say.  The posterior log-odds are the path's rate's plus the document's evidence.

A document is kept if its posterior of good quality is 0.5 or more and of toxicity is below 0.5.

Defined results: null and empty texts have no words, hence no evidence but their site's; null hosts
and paths are sites of their own; repeated rows count each; an empty table gives no rows; without
labelled rows of both classes a model says nothing (posterior 0.5 for quality, 0 for toxicity);
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dfprofile.llm.common import cut, drop_stash, fresh, give_back, load, pieces, stash

BUCKETS = 1 << 20
EDGE = ".,;:!?*&%$#@|-_=+~^'\"()[]{}<>/\\"


def _features(word: str) -> tuple[int, int, int, int]:
    """Buckets of the bare word in lower case, of its beginning, of the signs around it and of its
    case."""
    bare = word.strip(EDGE)
    signs = word.replace(bare, "\0", 1) if bare else word
    case = "U" if bare.isupper() and len(bare) > 1 else "T" if bare[:1].isupper() else "l"
    bare = bare.lower()
    return tuple(xxhash.xxh32_intdigest(x) % BUCKETS for x in ("w" + bare, "p" + bare[:5], "s" + signs, "c" + case))


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and log(1 + count) of each feature of each text.  Besides its words', a text
    has two features of its own: the share of words like the one before, and of distinct words."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    at, rows = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
    ids = np.array([_features(w) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 4)
    doc = np.repeat(np.arange(len(texts)), np.diff(rows))
    full = (pc.binary_length(coded.dictionary).to_numpy() > 0)[at]
    doc, at = doc[full], at[full]
    word, n = np.unique((doc << 32) | at, return_counts=True)  # a text's distinct words first
    key = (((word >> 32) * BUCKETS)[:, None] + ids[word & 0xFFFFFFFF]).ravel()
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.repeat(n, 4)[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(n, first) if len(first) else n
    key = key[first]
    size = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    again = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (at[1:] == at[:-1])], minlength=len(texts)) / size
    distinct = np.bincount(word >> 32, minlength=len(texts)) / size
    own = [np.arange(len(texts)) * BUCKETS + np.array(
        [xxhash.xxh32_intdigest(f"{kind}{int(x)}") % BUCKETS for x in 20 * share]) for kind, share in (("r", again), ("d", distinct))]
    key, total = np.concatenate([key, *own]), np.concatenate([total, *[np.full(len(texts), 20)] * 2])
    order = np.argsort(key, kind="stable")
    return key[order] // BUCKETS, key[order] % BUCKETS, np.log1p(total[order])


def _scale(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(doc, value * value, n))
    return 10 * value / norm[doc]


class Model:
    """Logistic regression; ``share``: features as shares of the text, else their presence."""

    def __init__(self, share: bool) -> None:
        self.share, self.w, self.b, self.base = share, np.zeros(BUCKETS), 0.0, 0.0

    def values(self, doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return _scale(doc, value, n) if self.share else np.ones(len(value))

    def logit(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return self.b + np.bincount(doc, self.values(doc, value, n) * self.w[feature], n)

    def fit(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 200) -> None:
        """``feature`` and ``value``: the features that go with the class, as ``values`` gives them."""
        n = len(y)
        self.base = self.b = math.log(y.mean() / (1 - y.mean()))
        seen = np.zeros(BUCKETS, bool)  # other features keep a weight of 0
        seen[feature] = True
        feature = (np.cumsum(seen, dtype=np.int32) - 1)[feature]
        w = self.w[seen]
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):
            z = self.b + np.bincount(doc, value * w[feature], n)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.append(np.bincount(feature, value * err[doc], len(w)) + 1e-5 * w, err.sum())
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            d = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
            w -= d[:-1]
            self.b -= d[-1]
        self.w = self.w.astype(np.float32)
        self.w[seen] = w


def _telling(known: DataFrame, n: int, ones: int) -> DataFrame:
    """Features that go with the class ``y`` of the ``n`` rows, ``ones`` of which are of class 1."""
    seen = known.select("y", F.explode("feature").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("y") == 1, 1)).alias("hits"))
    mean = ones / n
    expected = F.col("seen") * F.lit(mean)
    z = (F.col("hits") - expected) / F.sqrt(F.greatest(expected * F.lit(1 - mean), F.lit(1e-9)))
    return seen.where((F.col("seen") >= 4) & (F.abs(z) >= 4)).select("feature")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> dict[str, Model]:
    """Models of ``quality`` and ``toxic`` from up to ``max_rows`` labelled documents.  Features are
    counted by class in grouped aggregations; only those that go with a class reach the driver."""
    rows = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic")
    rows = rows.orderBy(F.xxhash64("id"), "quality", "toxic").limit(max_rows)  # the sample
    rows = (docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
            .join(F.broadcast(rows), "id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            doc, feature, value = counts(b.column("text"))
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("quality").cast(pa.int32()), b.column("toxic").cast(pa.int32()), *lists],
                                             names=["id", "quality", "toxic", "feature", "value"])

    sample = stash(rows.mapInArrow(extract, "id long, quality int, toxic int, feature array<int>, value array<float>"), "features")
    out = {}
    for name, share in (("quality", True), ("toxic", False)):
        model = out[name] = Model(share)
        known = sample.where(F.col(name).isNotNull()).select("id", F.col(name).alias("y"), "feature", "value")
        total = known.agg(F.count("y").alias("n"), F.sum("y").alias("ones"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
        if total["lo"] == total["hi"]:
            continue
        telling = np.sort([r[0] for r in _telling(known, total["n"], total["ones"]).collect()]).astype(np.int32)

        def pick(batches: Iterator[pa.RecordBatch], model=model, telling=telling) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
                size = pc.list_value_length(b.column("feature")).to_numpy()
                doc, feature = np.repeat(np.arange(b.num_rows), size), pc.list_flatten(b.column("feature")).to_numpy()
                value = model.values(doc, pc.list_flatten(b.column("value")).to_numpy(), b.num_rows)
                keep = np.isin(feature, telling)
                cuts = pa.array(np.searchsorted(doc[keep], np.arange(b.num_rows + 1)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(cuts, pa.array(x[keep])) for x in (feature, value))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), *lists], names=["id", "y", "feature", "value"])

        got = known.mapInArrow(pick, "id long, y int, feature array<int>, value array<double>").toArrow()
        got = got.sort_by([("id", "ascending")]).combine_chunks()
        give_back()  # the unsorted rows
        doc = np.repeat(np.arange(got.num_rows, dtype=np.int32), pc.list_value_length(got["feature"]).to_numpy())
        model.fit(doc, pc.list_flatten(got["feature"]).to_numpy(), pc.list_flatten(got["value"]).to_numpy(),
                  got["y"].to_numpy().astype(float))
        del got, doc
        give_back()
    drop_stash(sample)
    return out


def evidence(docs: DataFrame, model, *carry: str) -> DataFrame:
    """doc_id, host, path and the evidence (log-odds less the base rate) of each document, and, if
    there are any, the columns of ``carry`` and text_; ``model``: the broadcast models."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text_", 1 << 20, 10_000):
            c = counts(b.column("text_"))
            llr = [pa.array(np.clip(m.logit(*c, b.num_rows) - m.base, -30, 30)) for m in (model.value["quality"], model.value["toxic"])]
            rest = [x for x in b.schema.names if x != "text_" or carry]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in rest), *llr], names=[*rest, "q_llr", "t_llr"])

    rows = docs.select("doc_id_", "host_", "path_", *carry, F.coalesce("text", F.lit("")).alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text_" or carry)
    return rows.mapInArrow(score, schema + ", q_llr double, t_llr double")


def _shrunk(rates: DataFrame, name: str, by: list[str], prior) -> DataFrame:
    """Posterior rates: sums shrunk to ``prior`` with a strength from the spread between groups."""
    n, s = F.col("n"), F.col(name)
    spread = rates.agg(F.sum(n).alias("n"), F.sum(n * n).alias("n2"), F.count(F.lit(1)).alias("k"),
                       F.sum(n * F.pow(s / n - prior, 2)).alias("ss"), F.sum(s).alias("s")).first()
    if not spread["n"]:
        return rates.withColumn(f"{name}_rate", F.lit(0.5))
    mean = min(max(spread["s"] / spread["n"], 1e-6), 1 - 1e-6)
    within = mean * (1 - mean)
    size = spread["n"] - spread["n2"] / spread["n"]
    between = max((spread["ss"] - within * (spread["k"] - 1)) / size, 0.0) if size > 0 else 0.0
    strength = min(max(within / between - 1, 10.0), 1e6) if between > 0 else 1e6
    return rates.withColumn(f"{name}_rate", (s + strength * prior) / (n + strength))


def site_rates(scored: DataFrame, models: dict[str, Model]) -> DataFrame:
    """host, path, q_rate, t_rate: posteriors of each path, by way of its host's."""
    p = {c: 1 / (1 + F.exp(-(F.col(f"{c}_llr") + F.lit(models[m].base)))) for c, m in (("q", "quality"), ("t", "toxic"))}
    paths = cut(scored.groupBy("host_", "path_").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(c) for c, x in p.items())))
    hosts = paths.groupBy("host_").agg(*(F.sum(c).alias(c) for c in ("n", "q", "t")))
    total = paths.agg(*(F.sum(c).alias(c) for c in ("n", "q", "t"))).first()
    for c in ("q", "t"):
        hosts = _shrunk(hosts, c, ["host_"], F.lit((total[c] / total["n"]) if total["n"] else 0.5))
    hosts = hosts.select("host_", F.col("q_rate").alias("q_host"), F.col("t_rate").alias("t_host"))
    paths = cut(paths.join(hosts, paths.host_.eqNullSafe(hosts.host_)).drop(hosts.host_))
    for c in ("q", "t"):
        paths = _shrunk(paths, c, ["host_", "path_"], F.col(f"{c}_host"))
    return cut(paths.select(F.col("host_").alias("site"), F.col("path_").alias("part"), "q_host", "t_host", "q_rate", "t_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_rows: int = 12_000,
             carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, path, host_quality, path_quality, quality, toxic (posteriors), keep."""
    models = train(docs, labels, max_rows)
    rows = docs.withColumns({"doc_id_": F.col("doc_id").cast("long"), "host_": F.col(host).cast("string"),
                             "path_": F.col(path).cast("string")})
    shared = docs.sparkSession.sparkContext.broadcast(models)
    found = stash(evidence(rows, shared, *carry), "evidence")  # every text is read once
    shared.unpersist()
    rates = site_rates(found, models)
    if rates.count() <= 100_000:  # a checked size; beyond it both sides are shuffled
        rates = F.broadcast(rates)
    scored = found.join(
        rates, F.col("host_").eqNullSafe(F.col("site")) & F.col("path_").eqNullSafe(F.col("part")))

    def posterior(c: str):
        rate = F.least(F.greatest(F.col(f"{c}_rate"), F.lit(1e-4)), F.lit(1 - 1e-4))
        return 1 / (1 + F.exp(-(F.log(rate / (1 - rate)) + F.col(f"{c}_llr"))))

    quality = posterior("q") if models["quality"].base or models["quality"].w.any() else F.lit(0.5)
    toxic = posterior("t") if models["toxic"].base or models["toxic"].w.any() else F.lit(0.0)
    return scored.select(F.col("doc_id_").alias("doc_id"), F.col("host_").alias("host"), F.col("path_").alias("path"),
                         F.col("q_host").alias("host_quality"), F.col("q_rate").alias("path_quality"),
                         quality.alias("quality"), toxic.alias("toxic"),
                         ((quality >= 0.5) & (toxic < 0.5)).alias("keep"), *carry, *(["text_"] if carry else []))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    (mark,) = fresh(docs, "mark_")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]  # the text itself goes along once
    verdicts = docs.withColumn(mark, F.struct(F.col("text").isNull().alias("text"), *rest))
    kept = classify(verdicts, labels, carry=(mark,)).where("keep")
    return kept.withColumn(mark, F.col(mark).withField(
        "text", F.when(~F.col(f"{mark}.text"), F.col("text_")))).select(
        *[F.col(f"{mark}.`{c}`").alias(c) for c in docs.columns])


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
