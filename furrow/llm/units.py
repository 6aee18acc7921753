"""Distinct words of a block of texts, and their tokens by two kinds of vocabularies.

A text with the space that its encoding begins with is cut before every single space between characters that aren't white space. No merge of the vocabularies
used here crosses such a place, so that a text's tokens are those of its words, and each distinct word of a block is encoded once.
Texts with other spaces (at an end, or beside white space) are one word each, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from furrow.llm.tokens import JOINED, Encoder

#: White space that a pattern of a byte-level vocabulary counts as such, beside a space or at an end: there is no safe cut.
_ODD = r"^[ \t\n\x0b\x0c\r\x1c-\x1f]| $| [ \t\n\x0b\x0c\r]|[\t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}] |^[\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_MARK = "▁"


class Words(NamedTuple):
    """Distinct words, each with its space; `places` names the words of all texts one after the other, `starts` where each text's begin (and the end of all)."""

    words: list[str]
    places: np.ndarray
    starts: np.ndarray


def cut(texts: pa.Array) -> Words:
    """The words of texts none of which is null or empty."""
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.if_else(odd, "a", texts) if odd.any() else texts, " ")  # any word in place of those that are replaced below
    flat = pc.list_flatten(lists).dictionary_encode()
    words = [" " + w for w in flat.dictionary.to_pylist()]
    places = flat.indices.to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    own = np.flatnonzero(odd)
    places[starts[own]] = len(words) + np.arange(len(own))
    words += [" " + texts[int(i)].as_py() for i in own]
    return Words(words, places, starts)


class Tokens(NamedTuple):
    """Words' ids one word after the other, and how many each word has."""

    ids: np.ndarray
    counts: np.ndarray


def blocks(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, pa.Array]]:
    """(number of texts before, texts) in runs of about most_bytes; a longer text is a run of its own or ends one."""
    filled = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a)


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; added tokens' strings are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.size = self.encoder.vocab_size
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        pieces = [self.encoder.plain.id_to_token(i) or "" for i in range(self.size)]
        self.bytes = [bytes(map(byte_of.__getitem__, p)) if all(c in byte_of for c in p) else p.encode() for p in pieces]

    def encode(self, words: list[str]) -> Tokens:
        found = self.encoder.encode_words(pa.array(words, pa.string()))
        return Tokens(found.of(np.arange(len(words))).astype(np.int64), found.sizes)


class Pieces:
    """A SentencePiece vocabulary with byte fallback, which adds the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.bytes = [bytes([int(n[3:5], 16)]) if b else n.replace(_MARK, " ").encode() for n, b in zip(names, self.is_byte, strict=True)]
        self.opens = np.array([n.startswith(_MARK) for n in names])
        #: Bytes that stand for want of a piece; white space has none.
        self.falls_back = self.is_byte & np.array([b not in b" \t\n\x0b\x0c\r" for b in self.bytes])

    def encode(self, words: list[str]) -> Tokens:
        plain = [w for w in words if w.count(" ") == 1 and _MARK not in w]
        if len(plain) < len(words):  # words that hold spaces or the mark itself can't be told apart in a longer text
            alone = {w: self.model.encode(w[1:]) for w in words if w.count(" ") != 1 or _MARK in w}
            joined = iter(self._joined(plain))
            found = [alone[w] if w in alone else next(joined) for w in words]
            return Tokens(np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found)))
        ids, counts = self._together(plain)
        return Tokens(ids, counts)

    def _joined(self, words: list[str]) -> list[list[int]]:
        ids, counts = self._together(words)
        return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] if words else []

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one text: a piece that begins with the mark begins a word."""
        texts = ["".join(words[k : k + JOINED])[1:] for k in range(0, len(words), JOINED)]
        ids = np.fromiter(chain.from_iterable(self.model.encode(texts, num_threads=1)), np.int64)
        begins = np.flatnonzero(self.opens[ids])
        if len(begins) != len(words):
            raise ValueError("the vocabulary's pieces don't begin with the words' spaces")
        return ids, np.diff(np.append(begins, len(ids)))


@cache
def byte_level(path: str) -> ByteLevel:
    """One for each file and Python worker."""
    return ByteLevel(path)


@cache
def pieces(path: str) -> Pieces:
    """One for each file and Python worker."""
    return Pieces(path)
