"""Whole texts to token ids with the ``tokenizers`` library, each distinct word encoded once."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_PIECES = 100_000  # pieces kept by a worker, in each of two generations
JOINED = 20_000  # pieces encoded in one call
WORDS = 1 << 20  # words whose ids are laid out at once
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"  # each one letter in lower case too
# a piece of such letters, with punctuation behind them or a newline before them
PLAIN = rf"^(?P<newline>\n?)(?P<letters>[{LETTERS}]+)(?P<tail>[!-&(-/:;=?@\[-`{{}}~]*)$"
# the characters that byte-level vocabularies write bytes with; newlines stay, to part words
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
ALPHABET = np.zeros(256, np.uint32)
ALPHABET[_SHOWN] = _SHOWN
ALPHABET[[b for b in range(256) if b not in _SHOWN]] = np.arange(256, 512 - len(_SHOWN))
ALPHABET[10] = 10


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The supported vocabularies split a text at certain borders before they merge anything, so ids
    can be put together from parts that are encoded once and kept (up to fixed numbers):

    * before a space that follows another character than white space.  ``byte-level`` vocabularies
      give that space to the word behind it; others drop white space, and every space is a border;
    * on both sides of a single newline between other characters.

    A text with a piece that has no such border behind it (an empty one, or one that ends in white
    space, under ``byte-level``) is encoded whole.

    ``PLAIN`` pieces also have a border behind their letters.  Letters alone pass the vocabulary's
    normalizer and splitter but for their case, so they are encoded by the same model with neither,
    a batch's distinct ones in long calls of byte-level letters, and told apart by their tokens' lengths.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        two, a, space_b, b = (self._ids([x])[0] for x in ("a b", "a", " b", "b"))
        if two == a + b and space_b == b:
            self.lead, self.newline, self.sep = "", b"", " | "
        elif two == a + space_b:
            self.lead, self.newline, self.sep = " ", self._ids(["\n"])[0], "\n"
        else:
            raise ValueError(f"{path}: this vocabulary does not split texts at spaces")
        sep = self._ids([self.sep])[0]
        if len(sep) != 4 or self._ids([f"a{self.sep}b"])[0] != a + sep + b:
            raise ValueError(f"{path}: no separator of words")
        self.sep_id = int.from_bytes(sep, "little")
        self.pieces: dict[str, bytes | str] = {}
        self.older: dict[str, bytes | str] = {}
        self.tails: dict[str, np.ndarray] = {}
        self._plain(path)

    def _plain(self, path: str) -> None:
        """The model alone, as ``self.model``, and the letters in each of its tokens.  None where it
        does not give what the whole tokenizer gives."""
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.model.model, "end_of_word_suffix", None) or ""
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.letters = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.letters[i] = len(token.removesuffix(suffix) if suffix else token)
        try:
            self.fold = self._ids(["A"]) == self._ids(["a"])
            letters = [c for c in map(chr, range(0x17f)) if re.fullmatch(f"[{LETTERS}]", c)]
            words = [x for c in letters for x in (c, c * 3, f"{c}ation", f"The{c}", f"T{c}an")]
            some = pa.array([f"{nl}{w}" for w in words for nl in ("\n", "")])
            flat, first, size = self._letters(pc.extract_regex(some, PLAIN))
            alone = [x[1:] if x[0] == "\n" else self.lead + x for x in some.to_pylist()]
            for x, a, n in zip(self._ids(alone), first.tolist(), size.tolist()):
                if flat[a:a + n].tobytes() != x:
                    raise ValueError(f"{path}: letters are not encoded by the model alone")
        except ValueError:
            self.model = None

    def _letters(self, parts: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the letters of plain pieces, each distinct form once: all ids, and where those of
        each piece begin and how many they are."""
        forms = pc.struct_field(parts, "letters")
        if self.fold:
            forms = pc.utf8_lower(forms)
        if self.lead:
            forms = pc.binary_join_element_wise(
                pc.if_else(pc.equal(pc.struct_field(parts, "newline"), ""), self.lead, ""), forms, "")
        coded = forms.dictionary_encode()
        forms, at = coded.dictionary, coded.indices.to_numpy()
        ids = []
        for i in range(0, len(forms), JOINED):
            text = "\n".join(forms.slice(i, JOINED).to_pylist()).encode()
            text = ALPHABET[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le")
            ids.append(np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.cumsum(pc.binary_length(forms).to_numpy(), dtype=np.int64)
        upto = np.cumsum(self.letters[flat])
        last = np.searchsorted(upto, ends)
        if len(flat) and (last[-1] != len(flat) - 1 or (upto[last] != ends).any()):
            raise ValueError("tokens do not end with their words")
        last = last.astype(np.int32) + 1
        first = np.concatenate([np.zeros(1, np.int32), last])[:-1]
        return flat, first[at], (last - first)[at]

    def _tail(self, tail: str) -> np.ndarray:
        if tail not in self.tails:
            if len(self.tails) > 1000:
                self.tails.clear()
            self.tails[tail] = np.frombuffer(self._ids([tail])[0], np.uint32) if tail else np.zeros(0, np.uint32)
        return self.tails[tail]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str]) -> None:
        """Ids of pieces; a piece that begins with a newline has no space before it.  Pieces
        without a border behind them are kept as strings."""
        if len(self.pieces) > MAX_PIECES:  # two generations: pieces in use are kept
            self.older, self.pieces = self.pieces, {}
        memo, older, lead, mark = self.pieces, self.older, self.lead, self.sep.strip(" ")
        first, inner = [], []
        for p in missing:
            if p in older:
                memo[p] = older[p]
            elif not p:
                memo[p] = p if lead else b""
            elif lead and (p[-1].isspace() or p[0] == "\n" and p[1].isspace()):
                memo[p] = p
            elif mark in p[1:] or not lead and (mark == p[0] or p.isspace()):
                memo[p] = self._ids([p])[0] if p[0] == "\n" or not lead else self._ids([lead + p])[0]
            elif p[0] == "\n":
                first.append(p)
            else:
                inner.append(p)
        for some, cut, gap in ((first, 1, self.sep), (inner, 0, self.sep + lead)):
            for i in range(0, len(some), JOINED):
                part = some[i:i + JOINED]
                text = gap[len(self.sep):] + gap.join([p[1:] for p in part] if cut else part)
                raw = self._ids([text])[0]
                ends = (4 * np.flatnonzero(np.frombuffer(raw, np.uint32) == self.sep_id)).tolist()
                if len(ends) != len(part) - 1:
                    raise AssertionError("a piece holds the separator's id")
                a, before = 0, self.newline if cut else b""
                for p, b in zip(part, [*ends, len(raw)]):
                    memo[p] = before + raw[a:b]
                    a = b + 4

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: all ids, where those of each begin, how many they are, and whether
        it has no border behind it."""
        n = len(pieces)
        parts = pc.extract_regex(pieces, PLAIN) if self.model else pa.nulls(n, pa.struct([("letters", pa.string())]))
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        others = pieces.filter(pa.array(~plain)).to_pylist()
        get = self.pieces.get
        found = list(map(get, others))
        self._learn([p for p, x in zip(others, found) if x is None])
        memo = self.pieces
        found = [memo[p] if x is None else x for p, x in zip(others, found)]
        whole = np.zeros(n, bool)
        whole[~plain] = [isinstance(x, str) for x in found]
        found = [b"" if isinstance(x, str) else x for x in found] if whole.any() else found
        size = np.zeros(n, np.int32)
        size[~plain] = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        rest = np.frombuffer(b"".join(found), np.uint32)
        if not plain.any():
            return rest, np.cumsum(size, dtype=np.int32) - size, size, whole
        # plain pieces: a newline's ids, those of the letters, those of the tail
        parts = parts.drop_null()
        letters, at, n_letters = self._letters(parts)
        newline = np.frombuffer(self.newline, np.uint32)
        coded = pc.struct_field(parts, "tail").dictionary_encode()
        tails = [self._tail(x) for x in coded.dictionary.to_pylist()]
        n_tails = np.array([len(x) for x in tails], np.int32)
        which = coded.indices.to_numpy()
        flat = np.concatenate([letters, newline, *tails])
        begin = np.zeros((len(at), 3), np.int32)
        count = np.zeros((len(at), 3), np.int32)
        begin[:, 0] = len(letters)
        count[:, 0] = len(newline) * pc.equal(pc.struct_field(parts, "newline"), "\n").to_numpy(zero_copy_only=False)
        begin[:, 1], count[:, 1] = at, n_letters
        begin[:, 2] = len(letters) + len(newline) + (np.cumsum(n_tails) - n_tails)[which]
        count[:, 2] = n_tails[which]
        size[plain] = count.sum(axis=1)
        begin, count = begin.ravel(), count.ravel()
        ends = np.cumsum(count, dtype=np.int32)
        where = np.repeat(begin - (ends - count), count) + np.arange(ends[-1], dtype=np.int32)
        first = np.zeros(n, np.int32)
        first[plain] = np.cumsum(size[plain], dtype=np.int32) - size[plain]
        first[~plain] = ends[-1] + np.cumsum(size[~plain], dtype=np.int32) - size[~plain]
        return np.concatenate([flat[where], rest]), first, size, whole

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (a string array without nulls)."""
        if not len(texts):
            return []
        if self.lead:
            # the first piece has no space before it either; its newline's id is cut off again
            texts_ = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        else:
            texts_ = pc.replace_substring(texts, "\n", " ")
        split = pc.split_pattern(texts_, " ")
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        flat, first, size, whole = self._pieces(coded.dictionary)
        rows = split.offsets.to_numpy()
        rows = rows - rows[0]
        cut = len(self.newline) // 4
        out: list[bytes] = []
        lo = 0
        while lo < len(rows) - 1:  # texts of some WORDS words, one at least
            hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + WORDS, "right")) - 1)
            some = at[rows[lo]:rows[hi]]
            n = size[some]
            ends = np.cumsum(n, dtype=np.int32)  # a batch is far below 2 ** 31 ids
            where = np.repeat(first[some] - (ends - n), n)
            where += np.arange(ends[-1], dtype=np.int32)
            ids = flat[where].tobytes()
            bounds = (4 * np.concatenate([[0], ends])[rows[lo:hi + 1] - rows[lo]].astype(np.int64)).tolist()
            out += [ids[a + 4 * cut:b] for a, b in zip(bounds[:-1], bounds[1:])]
            lo = hi
        if whole.any():  # texts with a piece without a border behind it
            odd = np.unique(np.searchsorted(rows, np.flatnonzero(whole[at]), "right") - 1).tolist()
            for i, x in zip(odd, self._ids(texts.take(pa.array(odd)).to_pylist())):
                out[i] = x
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path)
