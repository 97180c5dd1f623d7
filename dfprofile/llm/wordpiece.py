"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over the UTF-8 bytes of a word and an end sign.  Greedy longest-match would
restart after each piece; here every trie node has a failure link, the node that is reached when the
longest pieces of the text up to the node are cut off, and the number of pieces that cutting pops,
both computed once.  Reading a word follows an edge, or else adds the popped count and follows the
failure link, so it is linear in the word and never builds a piece.

Words are the runs between white space, lower-cased as the vocabulary is.  A word that the vocabulary
cannot spell counts as one unknown token.  Equal words have equal counts, so each is read once and
kept, up to a fixed number of words.

Defined results: null and empty texts have 0 words and 0 tokens; repeated rows each give a row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dfprofile.llm.common import load, pieces, text_bytes

MAX_WORDS = 300_000
END = "\n"  # the end sign: no word holds white space


class Automaton:
    """Trie with failure links.  ``vocabulary``: pieces, those that may end a word with ``END`` behind
    them; bytes that are no whole characters stand as in Python's ``surrogateescape``."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.edges: list[dict[int, int]] = [{}]
        piece = [False]
        for token in vocabulary:
            at = 0
            for c in token.encode("utf-8", "surrogateescape"):
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    piece.append(False)
                at = nxt
            piece[at] = at > 0
        n = len(self.edges)
        self.fail, self.pops = [-1] * n, [0] * n
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for c, nxt in self.edges[at].items():
                todo.append(nxt)
                if piece[nxt]:
                    self.fail[nxt], self.pops[nxt] = 0, 1
                    continue
                back, popped = self.fail[at], self.pops[at]
                while back >= 0 and c not in self.edges[back]:
                    back, popped = self.fail[back], popped + self.pops[back]
                if back >= 0:
                    self.fail[nxt], self.pops[nxt] = self.edges[back][c], popped

    def count(self, word: str) -> int:
        """Pieces of greedy longest-match; 1 if the word cannot be spelt."""
        edges, fail, pops, at, n = self.edges, self.fail, self.pops, 0, 0
        for c in (word + END).encode():
            nxt = edges[at].get(c)
            while nxt is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
                nxt = edges[at].get(c)
            at = nxt
        while at > 0:
            n += pops[at]
            at = fail[at]
        return n if at == 0 else 1


class Counts(dict):
    """Memo of a word's count."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


def vocabulary(path: str, end: str = "</w>") -> list[str]:
    """Pieces of a tokenizers file whose words carry an end mark and whose characters stand for
    bytes, in plain characters; bytes that are no whole characters as in ``surrogateescape``."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    out = []
    for t in tokens:
        body, last = (t[:-len(end)], END) if t.endswith(end) else (t, "")
        out.append(bytes(byte[c] for c in body).decode("utf-8", "surrogateescape") + last)
    return out


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(Automaton(vocabulary(path)))


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_chars of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = counts(tokenizer_path).__getitem__
        for b in pieces(batches, "text"):
            words, tokens, chars = [], [], []
            for t in b.column("text").to_pylist():
                t = t.decode()
                w = t.lower().split()
                words.append(len(w))
                tokens.append(sum(map(length, w)))
                chars.append(len(t))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, tokens, chars))],
                names=["doc_id", "n_words", "n_tokens", "n_chars"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        count, "doc_id long, n_words long, n_tokens long, n_chars long")


def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
