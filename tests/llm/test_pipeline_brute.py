"""All rows of the pipeline against plain versions of its stages (the classifier's verdicts are taken
from its own query, whose accuracy is tested elsewhere)."""

import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from dfprofile.llm import quality

SF = "/root/testdata/sf0.001"


def planted(folder):
    """The small tables, with near copies, a passage in several documents, and benchmark items in some."""
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    docs = pq.read_table(f"{SF}/documents.parquet")
    rows = docs.to_pylist()
    items = [i["text"] for i in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    passage = "é " + " ".join(f"shared{i}" for i in range(60))
    new, extra = 10 ** 6, []
    for n, r in enumerate(rows[:40]):
        words = r["text"].split(" ")
        if n % 4 == 0:
            words[len(words) // 2] = "changed"
        elif n % 4 == 1:
            words = [*words[: len(words) // 3], passage, *words[::-1]]
        elif n % 4 == 2:
            item = items[n % len(items)].split(" ")
            item[len(item) // 2] = "changed"
            words = [*words[::-1], *item, "end"]
        else:
            words = [f"{n}own{i}" for i in range(30)] + [passage]
        extra.append({**r, "doc_id": new + n, "text": " ".join(words)})
    table = pa.Table.from_pylist([*rows, *extra, {**rows[0], "doc_id": new + 99, "text": None}], schema=docs.schema)
    pq.write_table(table, folder / "documents.parquet", row_group_size=50)
    return items


def one_of_each(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in texts.items() if find(i) == i}


def without_repeats(texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(t[p:p + 200] for t in raw.values() for p in range(len(t) - 199))
    out = {}
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p:p + 200]] > 1:
                gone[p:p + 200] = True
        out[i] = bytes(np.frombuffer(t, np.uint8)[~gone]).decode(errors="ignore")
    return out


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def holds(item, text):
    row = [0] * (len(text) + 1)  # any stretch of the text
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) <= int(0.2 * len(item) + 1e-9)


def test_all_rows_of_the_pipeline(spark, tmp_path):
    items = [words_of(t) for t in planted(tmp_path)]
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    keep = {r.doc_id for r in quality.classify(docs, labels).collect() if r.keep}
    good = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in keep}
    single = one_of_each(good)
    cut = without_repeats(single)
    clean = {i: t for i, t in cut.items() if not any(w and holds(w, words_of(t)) for w in items)}
    assert len(good) > len(single) == len(cut) > len(clean) > 20
    assert any(cut[i] != single[i] for i in clean)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in clean.items()}
    got, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(got) == set(want)
    for i, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = want[i][at:at + r.length]
            assert r.start == at and len(ids) == r.length > 0 and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
