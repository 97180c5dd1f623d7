import inspect
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from dfprofile.llm import decontaminate, jaccard, langid, packing, quality, repeats

SF = "/root/testdata/sf0.001"


def test_gradient_by_differences():
    net = langid.Network(["a", "b", "c"], hidden=4, seed=1)
    for part in (net.out, net.one.p, net.two.p):
        for k in part:
            part[k] = part[k].astype(np.float64)
    x, y = np.frombuffer(b"abcbcaaab", np.uint8).reshape(3, 3), np.array([0, 2, 1])

    def loss():
        return -np.mean([net.log_probs(x)[:, i, k] for i, k in enumerate(y)])
    for values, grads in net.gradient(x, y):
        for name, g in grads.items():
            for at in list(zip(*np.nonzero(np.abs(g) > 1e-6)))[:6]:
                keep, eps = values[name][at], 1e-3
                values[name][at] = keep + eps
                up = loss()
                values[name][at] = keep - eps
                slope, values[name][at] = (up - loss()) / (2 * eps), keep
                assert abs(slope - g[at]) < 1e-3 * max(1, abs(slope)) + 1e-4, name


def test_held_out_accuracy_and_edges(spark, edge_docs, empty_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.predict(docs, net).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95
    edge = {r.doc_id: r.lang_pred for r in langid.predict(edge_docs, net).collect()}
    assert edge[1] == edge[2] == edge[3] == "und" and edge[4] in net.labels
    assert langid.predict(empty_docs, net).count() == 0 and langid.train(empty_docs) is None
    assert {r.lang_pred for r in langid.predict(edge_docs, None).collect()} == {"und"}


def test_documents_pool_the_labels_of_their_runs(make_docs):
    net = langid.Network(["a", "b", "c"], hidden=4, seed=3)
    texts = ["one two  two\tthree", "12 34 ... !", "x" * 60 + " é" + "中文" * 20, "", None, "7 up", "a\x0bb\x0cc\nd "]
    got = {r.doc_id: r for r in langid.predict(make_docs(list(enumerate(texts))), net).collect()}
    for i, t in enumerate(texts):
        logs, probs = np.zeros(3), np.zeros(3)
        for w in (t or "").encode().split():
            if any(c.isalpha() for c in w.decode()):
                for a in range(0, len(w), langid.RUN):
                    lp = net.log_probs(np.frombuffer(w[a:a + langid.RUN], np.uint8)[None, :])[:, 0]
                    logs, probs = logs + lp.sum(0), probs + np.exp(lp).sum(0)
        best = int(logs.argmax())
        want = (net.labels[best], probs[best] / probs.sum()) if probs.sum() else ("und", 0.0)
        assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-5


def test_training_takes_the_lowest_hashes_of_different_texts(spark, make_docs, monkeypatch):
    held = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, runs, label: held.extend(runs))
    rows = [(i, f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}"
             f"{'abcdefghij'[i // 1000 % 10]}" if i % 3 else "copied", "en", "s", 1) for i in range(3000)]
    docs = make_docs(rows)
    langid.train(docs, max_docs=12)
    fit = docs.where(~langid.held_out()).selectExpr("text", "xxhash64(text) AS k").distinct()
    assert sorted(held) == sorted(r.text.encode() for r in fit.orderBy("k").limit(12).collect())


def test_training_reads_all_stretches_of_a_run(spark, make_docs, monkeypatch):
    held = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, runs, label: held.extend(zip(runs, label.tolist())))
    long, dots = "".join(chr(0x4E00 + i) for i in range(30)), "abc" + "." * 50
    rows = [(i, f"{long} short {'x' * 24} 12 {dots}", "zh", "s", 1) for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    net = langid.train(make_docs(rows))
    words = [w.encode() for w in (long, "short", "x" * 24, dots)]
    assert net.labels == ["zh"] and sorted(r for r, _ in held) == sorted(
        {w[a:a + langid.RUN] for w in words for a in range(0, len(w), langid.RUN)})
    few = len(held) - 2
    held.clear()
    langid.train(make_docs(rows), max_runs=few)
    assert len(held) == few


def test_quality_keeps_clean_and_drops_bad(spark, edge_docs, empty_docs):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    known = labels.collect()
    clean = [got[r.doc_id].keep for r in known if r.quality == 1 and r.toxic == 0]
    bad = [got[r.doc_id].keep for r in known if r.quality == 0 or r.toxic == 1]
    assert np.mean(clean) > 0.97 and np.mean(bad) < 0.15
    assert quality.accepted(edge_docs, labels).columns == edge_docs.columns
    assert quality.classify(edge_docs, labels).count() == 10
    assert quality.classify(empty_docs, labels).count() == 0
    none = labels.where("false")
    assert {(r.quality, r.toxic, r.keep) for r in quality.classify(edge_docs, none).collect()} == {(0.5, 0.0, True)}


def test_only_features_that_go_with_the_class_reach_the_driver(spark, monkeypatch):
    assert inspect.signature(quality.train).parameters["max_rows"].default == 12_000
    assert inspect.signature(quality.classify).parameters["max_rows"].default == 12_000
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.selectExpr("doc_id", "quality", "if(doc_id % 7 = 0, null, toxic) AS toxic")
    held, fit = [], quality.Model.fit
    monkeypatch.setattr(quality.Model, "fit", lambda self, *a, **k: (held.append((self.share, *a)), fit(self, *a, **k)))
    models = quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").where("text is not null").orderBy("doc_id").toArrow().combine_chunks()
    assert rows.num_rows > 100
    for share, doc, feature, value, y in held:
        name = "quality" if share else "toxic"
        known = rows.filter(pc.is_valid(rows[name])).combine_chunks()
        d, f, v = quality.counts(known["text"].combine_chunks())
        v, want = v.astype(np.float32), known[name].to_numpy()
        seen, hits = np.bincount(f, minlength=quality.BUCKETS), np.bincount(f[want[d] == 1], minlength=quality.BUCKETS)
        z = (hits - seen * want.mean()) / np.sqrt(np.maximum(seen * want.mean() * (1 - want.mean()), 1e-9))
        keep = ((seen >= 4) & (np.abs(z) >= 4))[f]
        assert y.tolist() == want.tolist() and 0 < keep.sum() < len(f)
        assert doc.tolist() == d[keep].tolist() and feature.tolist() == f[keep].tolist()
        assert np.allclose(value, models[name].values(d, v, len(y))[keep])
    assert len(held) == 2


def test_fit_holds_no_more_than_its_features():
    rng = np.random.default_rng(5)
    doc, feature = np.repeat(np.arange(200), 20), rng.choice(rng.integers(0, quality.BUCKETS, 300), 4000)
    value, y = rng.random(4000), (rng.random(200) < 0.3).astype(float)
    model = quality.Model(True)
    tracemalloc.start()
    model.fit(doc, feature, value, y, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    w, b = np.zeros(quality.BUCKETS), model.base  # the same over all buckets
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, 31):
        err = (1 / (1 + np.exp(-np.clip(b + np.bincount(doc, value * w[feature], 200), -30, 30))) - y) / 200
        g = np.append(np.bincount(feature, value * err[doc], len(w)) + 1e-5 * w, err.sum())
        m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
        d = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    assert model.b == b and (model.w == w.astype(np.float32)).all() and model.w.any()


def test_shrinkage_follows_site_size(spark):
    rows = [("a", 1000, 900.0), ("b", 1000, 100.0), ("c", 2, 2.0), ("d", 500, 400.0)]
    rates = spark.createDataFrame(rows, "host_ string, n long, q double")
    from pyspark.sql import functions as F
    got = {r.host_: r.q_rate for r in quality._shrunk(rates, "q", ["host_"], F.lit(0.56)).collect()}
    assert abs(got["a"] - 0.9) < 0.02 and 0.56 < got["c"] < 0.8 and abs(got["b"] - 0.1) < 0.02


def test_pipeline_stages(spark, edge_docs, empty_docs):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for docs in (edge_docs, empty_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in rows.collect()}
    good = quality.accepted(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids and good.columns == columns and ids <= {r.doc_id for r in good.collect()}


def test_stages_send_texts_to_workers_in_small_batches(spark, make_docs, monkeypatch):
    docs = make_docs([(i, f"{i} " + "x" * 100_000) for i in range(100)]).coalesce(1)

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)

    operators = [(quality, "accepted"), (jaccard, "one_of_each"), (repeats, "without_repeats"),
                 (decontaminate, "without_benchmark"), (packing, "pack_documents")]
    before = spark.conf.get(corpus_pipeline.BATCH)
    try:
        for (_, stage), (module, name) in zip(corpus_pipeline.STAGES, operators, strict=True):
            spark.conf.set(corpus_pipeline.BATCH, "64m")
            monkeypatch.setattr(module, name, lambda docs, *_, **__: docs.select("text").mapInArrow(sizes, "n long"))
            n = [r.n for r in stage(spark, docs, SF).collect()]
            assert sum(n) > 10_000_000 and max(n) < 3 << 20, name
            monkeypatch.setattr(module, name, lambda docs, *_, **__: docs)
        spark.conf.set(corpus_pipeline.BATCH, "64m")
        assert corpus_pipeline.run(spark, SF).count() and spark.conf.get(corpus_pipeline.BATCH) == "64m"
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
