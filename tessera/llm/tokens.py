"""Whole-text tokenisation inside Arrow batches, with a cache by word of bounded bytes.

A byte-level BPE tokenizer first splits a text before every space that a
non-space follows, and then merges bytes inside each piece alone.  The ids of a
text are therefore the ids of its pieces one after another, and a piece seen
before need not be merged again.  Tokenizers of another kind are called on the
whole text.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np

#: Bytes of words that one Python worker remembers, what an entry takes, and the most letters of a word that is kept.
CACHE_BYTES, ENTRY, LETTERS = 207_000_000, 230, 64
#: Marks that may end a word; a run of them is a piece of its own.
_ENDS = ".,;:!?%$&*#|)"


class _Odd(Exception):
    """A space that no non-space follows: not a piece's start."""


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for a byte: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


@lru_cache(maxsize=4)
def shape(path: str) -> tuple[int, bool]:
    """(number of ids, whether pieces at spaces may be encoded alone)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    split = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
             and all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word") or " " in a["content"])
                     for a in spec.get("added_tokens", [])))
    ids = [*spec["model"]["vocab"].values()] if isinstance(spec["model"]["vocab"], dict) else []
    top = max([0, *ids, *(a["id"] for a in spec.get("added_tokens", []))])
    return top + 1, bool(split)


class _Words(dict):
    """Ids of words, each after ``before`` (a space or nothing), found when first asked for.

    A word of (Latin) letters is one piece and goes straight to the model; marks
    behind it are another piece, and so is a line break between two such words.
    Everything else is encoded as a text."""

    def __init__(self, owner: Encoder, before: str):
        super().__init__()
        self.owner, self.before, self.code, self.tokenize = owner, before, owner.code, owner.tokenize
        self.mark = before.translate(owner.letters)

    def _plain(self, word: str) -> bytes | None:
        base = word.rstrip(_ENDS)
        if not base.isalpha():
            return None
        if len(base) != len(word):
            return self[base] + self.owner.piece(word[len(base):]) if base.isascii() or max(base) < "\u0250" else None
        if base.isascii():
            piece = self.mark + base  # these letters stand for themselves
        elif max(base) < "\u0250":
            piece = self.mark + base.encode().decode("latin-1").translate(self.owner.letters)
        else:
            return None
        return array(self.code, [x.id for x in self.tokenize(piece)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.before and (not word or word[0].isspace()):
            raise _Odd
        ids = self._plain(word) if word else None
        if ids is None and "\n" in word:
            head, _, tail = word.partition("\n")
            if head and tail[:1].isalpha() and head[-1:].strip() and (first := self._plain(head)) is not None:
                ids = first + self.owner.piece("\n") + self.owner.bare[tail]
        if ids is None:
            ids = self.owner.whole(self.before + word)
        if len(word) <= LETTERS:
            self[word] = ids
        return ids


class Encoder:
    """Texts to little-endian unsigned ids; one for each worker and tokenizer.  With
    ``plain_specials`` the strings of special tokens are ordinary text."""

    def __init__(self, path: str, dtype: str, cache_bytes: int = CACHE_BYTES, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_specials
        self.dtype, self.most = np.dtype(dtype), cache_bytes // ENTRY  # words
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.split = shape(path)[1]
        self.letters, self.pieces = _byte_letters(), {}
        self.tokenize = self.tok.model.tokenize
        self.spaced, self.bare = _Words(self, " "), _Words(self, "")

    def whole(self, text: str) -> bytes:
        """The ids of a text, by the tokenizer itself."""
        ids = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return array(self.code, ids).tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of a mark or line break."""
        found = self.pieces.get(text)
        if found is None:
            found = self.whole(text)
            if len(text) <= LETTERS:
                self.pieces[text] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        out = []
        for t in texts:
            self._forget()
            if not t:
                out.append(b"")
            elif not self.split or t[0] == " ":
                out.append(self.whole(t))
            else:
                words = t.split(" ")
                try:
                    out.append(self.bare[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:])))
                except _Odd:
                    out.append(self.whole(t))
        return out

    def encode_spaced(self, texts: list[str]) -> list[bytes]:
        """The ids of a space and each text as bytes; an empty text has none."""
        out = []
        for t in texts:
            self._forget()
            if not t:
                out.append(b"")
            elif not self.split or t[0] == " ":
                out.append(self.whole(" " + t))
            else:
                words = t.split(" ")
                try:
                    first = self.whole(" " + words[0]) if words[0][0].isspace() else self.spaced[words[0]]
                    out.append(first + b"".join(map(self.spaced.__getitem__, words[1:])))
                except _Odd:
                    out.append(self.whole(" " + t))
        return out

    def _forget(self) -> None:
        if len(self.spaced) + len(self.bare) > self.most:
            self.spaced.clear()
            self.bare.clear()
        if len(self.pieces) > self.most:
            self.pieces.clear()


@lru_cache(maxsize=1)
def encoder(path: str, dtype: str, cache_bytes: int = CACHE_BYTES, plain_specials: bool = False) -> Encoder:
    """This worker's encoder; another one replaces it."""
    return Encoder(path, dtype, cache_bytes, plain_specials)


def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {v: k for k, v in _byte_letters().items()}
    out = {i: bytes(map(back.__getitem__, map(ord, t))) if all(ord(c) in back for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
    out |= {a["id"]: a["content"].encode() for a in spec.get("added_tokens", [])}
    return [out.get(i, b"") for i in range(max(out, default=-1) + 1)]


def id_type(path: str) -> str:
    """The narrowest little-endian unsigned type that holds every id."""
    return "<u2" if shape(path)[0] <= 1 << 16 else "<u4"


def keyed(batch, rows: int = 1000, most_chars: int = 1_000_000):
    """Pieces of an Arrow batch of (key, text): lists of keys and of texts (null:
    empty), of about ``most_chars`` characters at most."""
    for a in range(0, batch.num_rows, rows):
        part = batch.slice(a, rows)
        keys, texts, n = [], [], 0
        for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t or "")
            n += len(texts[-1])
            if n >= most_chars:
                yield keys, texts
                keys, texts, n = [], [], 0
        if keys:
            yield keys, texts
