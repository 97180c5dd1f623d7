import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dfprofile.llm import packing, token_files, wordpiece
from dfprofile.llm.common import scratch, stash
from dfprofile.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
BITS = ["foo", " ", "  ", "\n", "\n\n", ".\n", "it's", "'s", "***", "é", "é", "　", "日本", "12", "|", "<|endoftext|>",
        "\t", "\r\n", "İ", "ΑΣ", "!?", "b", "🙂", "\x85", "_", "̸", ""]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_library(name):
    path, rng = public_tokenizers.path(name), random.Random(5)
    enc, tok = Encoder(path), Tokenizer.from_file(path)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", "\n", " ", "|"]
    for i in range(0, len(texts), 500):
        part = texts[i:i + 500]
        for t, got in zip(part, enc.encode(pa.array(part))):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", FILES)
def test_encoder_keeps_no_plain_words(name):
    """Words of letters are encoded by the model alone, whatever stands behind them, and not kept."""
    path, rng = public_tokenizers.path(name), random.Random(7)
    enc, tok = Encoder(path), Tokenizer.from_file(path)
    letters = "aeinrstAEÀÉßàéüñøĀŁłŒœŠžŽ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    ends = ["", "", ".", ",", "!?", "###", "$$$", ").", "_", "...", "\n", ".\n"]
    texts = ["a" + "".join(rng.choice(words) + (e := rng.choice(ends)) + ("" if e[-1:] == "\n" else " ")
                           for _ in range(60)) + "z" for _ in range(300)]
    for i in range(0, len(texts), 100):
        part = texts[i:i + 100]
        for t, got in zip(part, enc.encode(pa.array(part))):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert not enc.pieces


def test_packing_is_a_partition_with_little_padding(spark, edge_docs):
    path = public_tokenizers.path(FILES[1])
    tok = Tokenizer.from_file(path)
    parts = stash(packing.token_pieces(edge_docs, path, 64, with_ids=True), "t")
    packed = packing.pack(parts, 64)
    rows = packed.collect()
    want = Counter()
    for r in edge_docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        for i in range(0, len(ids), 64):
            want[(r.doc_id, i, len(ids[i:i + 64]), crc(ids[i:i + 64]), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by_seq) == list(range(len(by_seq)))
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in rows) and max(len(r.ids) for r in whole) <= 64


def test_plan_packs_places_every_rank_once():
    rng = random.Random(2)
    hist = {n: rng.randint(1, 500) for n in rng.sample(range(1, 257), 60)}
    places, fill = packing.plan_packs(hist, 256), Counter()
    ranks = {n: [] for n in hist}
    for length, lo, hi, first, per, at in places:
        ranks[length] += range(lo, hi)
        for i in range(hi - lo):
            assert fill[first + i // per] == at + (i % per) * length
            fill[first + i // per] += length
    assert all(sorted(v) == list(range(hist[n])) for n, v in ranks.items()) and max(fill.values()) <= 256
    assert sum(fill.values()) / (256 * len(fill)) > 0.9
    equal = packing.plan_packs({100: 1000}, 4096)
    assert sum((hi - lo) for _, lo, hi, *_ in equal) == 1000 and max(p[3] for p in equal) <= 25


def test_token_files_round_trip(spark, edge_docs):
    path, folder = public_tokenizers.path(FILES[0]), scratch(spark, "t")
    tok = Tokenizer.from_file(path)
    token_files.write_tokens(edge_docs, folder, path)
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    at, want = 0, Counter()
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    for r in edge_docs.collect():
        want[(r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [2]))] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    digests = {(r.start, r.ids_crc32) for r in token_files.read_digests(spark, folder).collect()}
    assert digests == {(r.start, crc(r.ids)) for r in rows}


def test_empty_tables(spark, empty_docs):
    path = public_tokenizers.path(FILES[0])
    assert packing.pack_documents(empty_docs, path).count() == 0
    folder = scratch(spark, "t")
    token_files.write_tokens(empty_docs, folder, path)
    assert token_files.read_digests(spark, folder).count() == 0
    assert wordpiece.token_counts(empty_docs, public_tokenizers.path(FILES[1])).count() == 0


def greedy(vocab, word):
    word, n, i = word + wordpiece.END, 0, 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocab), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(11)
    for _ in range(60):
        vocab = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + rng.choice(["", wordpiece.END]) for _ in range(12)}
        auto = wordpiece.Automaton(sorted(vocab))
        for _ in range(200):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            assert auto.count(word) == greedy(vocab, word), (vocab, word)


def test_token_counts(spark, edge_docs):
    path = public_tokenizers.path(FILES[1])
    vocab = set(wordpiece.vocabulary(path))
    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in wordpiece.token_counts(edge_docs, path).collect())
    words = [(r.doc_id, (r.text or "").lower().split()) for r in edge_docs.collect()]
    assert got == Counter((i, len(w), sum(greedy(vocab, x) for x in w)) for i, w in words)


def byte_pieces(path):
    """Every piece of the file as bytes, and those that end a word; byte 10 stands for the end too."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    byte = {chr(b if b in plain else next(other)): b for b in range(256)}
    return {bytes(byte[c] for c in t.removesuffix("</w>")) + b"\n" * t.endswith("</w>") for t in pieces}


def test_token_counts_read_all_byte_pieces(spark, make_docs):
    path = public_tokenizers.path(FILES[1])
    vocab = byte_pieces(path)
    assert len(wordpiece.vocabulary(path)) == len(set(wordpiece.vocabulary(path))) == len(vocab) == 49406

    def count(word):
        word, n, i = word.encode() + b"\n", 0, 0
        while i < len(word):
            i = next(j for j in range(len(word), i, -1) if word[i:j] in vocab)
            n += 1
        return n
    words = ["größe", "straße", "日本語の文章", "龘靐齉", "언어", "щёлк", "ѣ", "🦤", "naïve", "ꙮ", "plain"]
    assert (count("größe"), count("straße")) == (5, 4)
    rows = [(i, w) for i, w in enumerate(words)] + [(50, " ".join(words))]
    got = {r.doc_id: r.n_tokens for r in wordpiece.token_counts(make_docs(rows), path).collect()}
    assert got == {i: count(w) for i, w in enumerate(words)} | {50: sum(map(count, words))}
    assert wordpiece.token_counts(make_docs([(1, "龘" * 500)]), path).first().n_tokens == count("龘" * 500) >= 500
