"""Alignment and trie against brute force; the subsequence kernel against its definition."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dfprofile.llm import align, scan, toxicity, trie

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))

TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "a\r\nb\tc", "x▁y",
         "<|endoftext|> <s> <0x41>", "don't won't  I'll", "日本語 テキスト。\n漢字", "é é ﬁ ａ", "a\xa0b \xa0c",
         " x 　 y　\nz", "😀 😀😀\n😀", "a\x00b", "\n", "\n\n", "a\nb\nc d\ne f", "a\n\n\nb  \n  c", "x" * 5000 + " " + "ab " * 3000,
         "\x1c a\x1cb\n\x1cc", "1 22 333\n4444 5,5", "؟ سلام عليكم", "a\x85\nb", "a \x0b\n b"]


def aligned(rows):
    """The contract, token by token, with the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, found, count = align._byte_letters(), [], Counter()
    for doc, text in rows:
        a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode())
             for i in sp.encode(text or "") for p in [sp.id_to_piece(i)]]
        if not text or not b"".join(x for _, x in a) == b"".join(x for _, x in b) == b" " + text.encode():
            found.append((doc, [], [], [], []))
            continue
        spans = []
        for side in (a, b):
            ends = list(itertools.accumulate(len(x) for _, x in side))
            spans.append([(i, s, e) for (i, _), s, e in zip(side, [0, *ends], ends)])
        links = []
        j = 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            links += [(i, o) for o, t, f in itertools.takewhile(lambda x: x[1] < e, spans[1][j:])]
        both = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        groups = []
        at = [0, 0]
        for end in both:
            part = []
            for k in (0, 1):
                stop = at[k]
                while stop < len(spans[k]) and spans[k][stop][2] <= end:
                    stop += 1
                part.append(",".join(str(x[0]) for x in spans[k][at[k]:stop]))
                at[k] = stop
            groups.append("|".join(part))
        count.update(links)
        found.append((doc, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(doc, len(a), len(b), len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for doc, a, b, g, k in found]


@pytest.mark.parametrize("most", [align.MOST_BROADCAST, 0])
def test_alignment_is_that_of_whole_texts(spark, most):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, "same id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, pair string").repartition(3)
    got = [tuple(r) for r in align.align(df, A, B, most).collect()]
    assert sorted(got, key=str) == sorted(aligned(rows), key=str)


def test_alignment_of_no_rows_and_of_no_tokens(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(df, A, B).collect() == []
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for most in (10, 0):
        assert sorted(map(tuple, align.align(df, A, B, most).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_pair_counts_flush(spark):
    df = spark.createDataFrame([(i, "one two three four " * (i + 1)) for i in range(20)], "doc_id long, text string").repartition(5)
    batches = align.aligned_batches(df, A, B).cache()
    want = sorted(map(tuple, align.pair_counts(batches).collect()))
    assert sorted(map(tuple, align.pair_counts(batches, flush=3).collect())) == want
    batches.unpersist()


def test_batches_are_stored_as_a_small_row_group_each(spark, monkeypatch):
    """Spark's readers hold a row group at a time, and arrays element by element."""
    import pyarrow.parquet as pq

    stored = {}
    keep = align.stash
    monkeypatch.setattr(align, "stash", lambda df, tag, *options: stored.setdefault(tag, keep(df, tag, *options)))
    rows = [(i, f"word{i} and {i * i} " * 90_000) for i in range(4)]  # a batch each
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in align.align(df, A, B).collect()) == [0, 1, 2, 3]
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in stored["aligned"].inputFiles()]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert [g.num_rows for g in groups] == [1] * 4
    per_document = sum(g.column(i).num_values for g in groups for i in range(g.num_columns)
                       if not g.column(i).path_in_schema.startswith("pair"))
    assert per_document == 2 * len(groups)  # values, not elements: the batch's name and its body


def test_packed_numbers_stay_as_they_are():
    for top in (0, 1, 255, 256, 65_535, 65_536, 2 ** 32):
        x = np.array([0, top // 2, top], np.int64)
        assert align._small(x).tolist() == x.tolist()
    assert align._small(np.zeros(0, np.int64)).tolist() == []
    row = {k: np.arange(i) for i, k in enumerate(align.BODY)} | {"doc_id": pa.array([5, None, 5, 7])[1:], "sha": pa.array(["", "é"])}
    got = align._unpacked(pa.scalar(align._packed(row), pa.binary()))
    assert {k: v.to_pylist() for k, v in got.items()} == {k: v.tolist() for k, v in row.items()}


def test_units_grow_old(monkeypatch):
    monkeypatch.setattr(align, "MEMO", 2)
    pair = align.Pair(A, B)
    want = {u: align.Pair(A, B).tokens([u]) for u in (" a", " b", " c", "\nd", " e f")}
    for some in ([" a", " b", " c"], [" a", "\nd"], [" b", " e f", " c"], [" a", " c"]):
        for u, x, y in zip(some, *pair.tokens(some)):
            assert ([x], [y]) == want[u]


def test_chains_end_at_common_borders():
    a, b = np.array([2, 5, 6, 9, 10]), np.array([1, 4, 6, 10])
    assert align._converge(a, b).tolist() == [2, 2, 2, 4, 4, 2, 2, 2, 4]


def nodes(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [y[3:] for y in sorted(v)] for c, v in conv.items()}
    whole = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, kids, below = defaultdict(list), defaultdict(set), {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
            if d:
                kids[whole[c][:d - 1]].add(whole[c][:d])
    for k in sorted(members, key=len, reverse=True):
        below[k] = (sum(below[x][0] for x in kids[k]) or 1,
                    sum(below[x][1] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0))
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), *below[k],
                   hashlib.sha256(",".join(str(c) for c in m if whole[c] == k).encode()).hexdigest()) for k, m in members.items())


@pytest.mark.parametrize("block", [trie.BLOCK, 7])
def test_trie_is_that_of_brute_force(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice([None, -7, 0, 1, 2, 3, 4, 5, 10, 11, 12, 13]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "u", "a"]),
             rng.choice([None, "", "x", "é"])) for _ in range(120)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    out = trie.trie(*trie.rebuilt(trie.numbered(df)), block)
    got = [tuple(r) for r in out.collect()]
    assert sorted(r[:8] for r in got) == nodes(rows)
    assert sorted(x for r in got for x in r[8:]) == list(range(2 * len(got)))  # every place of the tour once


def test_trie_of_no_rows_and_of_many_copies(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.trie(*trie.rebuilt(trie.numbered(spark.createDataFrame([], schema)))).collect() == []
    rows = [(c, t, "user", f"t{t}") for c in range(0, 400) for t in range(12 if c % 100 == 0 else 1)]
    df = spark.createDataFrame(rows, schema)
    got = trie.trie(*trie.rebuilt(trie.numbered(df)), 50).drop("enter_at", "exit_at")
    assert sorted(map(tuple, got.collect())) == nodes(rows)


def test_scan_carries_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 9]), i, rng.randrange(-2 ** 62, 2 ** 62)) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(6)
    got = sorted(tuple(r) for r in scan.scan(df, ["g"], ["o"], ("v",), "v").select("g", "o", "n_", "v_", "previous_").collect())
    want, n, sums, last = [], Counter(), Counter(), {}
    for g, o, v in sorted(rows):
        n[g] += 1
        sums[g] += v
        want.append((g, o, n[g], (sums[g] + 2 ** 63) % 2 ** 64 - 2 ** 63, last.get(g)))
        last[g] = v
    assert got == want


def kernel(a, b):
    """The definition: all pairs of equal subsequences of three letters, by their spans."""
    def parts(w):
        code = toxicity.fold([w])[0].tolist()
        for i, j, k in itertools.combinations(range(len(code)), 3):
            if k - i < toxicity.SPAN and code[i] and code[j] and code[k]:
                yield (code[i], code[j], code[k]), toxicity.DECAY ** (k - i + 1)

    def product(x, y):
        sums = [defaultdict(float), defaultdict(float)]
        for s, w in zip(sums, (x, y)):
            for key, value in parts(w):
                s[key] += value
        return sum(v * sums[1][key] for key, v in sums[0].items())

    norm = math.sqrt(product(a, a) * product(b, b))
    value = product(a, b) / norm if norm else 0.0
    return value ** toxicity.POWER if value >= toxicity.LEAST else 0.0


def test_kernel_is_that_of_the_definition():
    marks = ["idiot", "moron", "pathetic", "banana", "ünïque"]
    words = ["idiot", "IDIOT".lower(), "i-d-i-o-t", "id.iot", "1d10t", "idiooot", "xidiotx", "morons", "m o", "", "..", "anan", "bananana",
             "path*etic", "unique", "ab", "日本語文", "pathpathetic"]
    m = toxicity.Landmarks(marks)
    got = np.zeros((len(words), len(marks)))
    w, k, v = m.kernel(words)
    got[w, k] = v
    assert np.allclose(got, [[kernel(a, b) for b in marks] for a in words])
    assert got[:5, 0].min() > 0.1 and got[5, 0] > 0


def test_long_words_and_spaced_letters():
    m = toxicity.Landmarks(["idiot"])

    def found(text):
        s = toxicity.Sentences(pa.array([text]))
        return len(s.kernel(m)[0])

    assert found("you i d i o t !") and found("-" * 100 + "idiot" + "-" * 500) and not found("you i d") and not found("")
    s = toxicity.Sentences(pa.array(["One two. Three i d i", "o t", "", "x! y"]))
    assert s.doc.tolist() == [0, 0, 1, 2, 3, 3] and "idi" in s.words and "idiot" not in s.words


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice(["an", "the", "or", "ing", "st", "ly"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        words = rng.choices(plain, k=rng.randrange(10, 80))
        for _ in range(3 * bad):
            w = rng.choice(["gropnik", "wuzzlod"])
            words.insert(rng.randrange(len(words)), rng.choice([w, w, w.upper(), "-".join(w), w + "s"]))
        rows.append((i, " ".join(w + "." * (rng.random() < 0.1) for w in words), f"src{i % 3}"))
        labels.append((i, int(bad), 1))
    rows += [(900, None, None), (901, "", None), (None, "gropnik wuzzlod. " * 3, None), (3, rows[3][1], None), (902, "w u z z l o d. gropnik. wuzzlod", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (901, None, 1), (900, 7, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, marks)
    assert {"gropnik", "wuzzlod"} <= set(model.landmarks.words)
    got = toxicity.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.predicted == (r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean(right) > 0.97
    assert [r.predicted for r in got if r.doc_id in (None, 902)] == [1, 1] and [r.predicted for r in got if r.doc_id in (900, 901)] == [0, 0]
    fold = marks.where(~toxicity.held_out())  # held-out labels change nothing
    again = toxicity.predict(docs, toxicity.train(docs, fold)).collect()
    assert sorted(again, key=str) == sorted(got, key=str)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, empty) is None
    assert [r.score for r in toxicity.predict(docs, None).collect()] == [0.0, 0.0]
    assert toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")) is None
    assert toxicity.predict(docs.limit(0), None).collect() == []
