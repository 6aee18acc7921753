"""Encoding whole texts by the tokenizers library, a word at a time with a memory of words.

The tokenizers used here split a text before any merge, and always between a character that isn't white space and
ASCII white space. A text's ids are therefore those of its words (with the white space before them, if it counts), one
after the other, and a word seen before need not be encoded again. Arrow cuts a block of texts at single spaces and
numbers its distinct words; only these are looked up, all at once in an Arrow array of the words known, and those that are new are encoded in one call. Texts with
other white space beside a space are cut by a pattern, or encoded whole where no cut is safe, as in texts with an added token's string.
Where the tokenizer itself parts letters, digits and signs (byte-level vocabularies), distinct words are cut there too, and it is these pieces that are known.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that can't be cut at every space: with a space at an end or beside other ASCII white space, or other white space before ASCII white space.
_IRREGULAR = r"^ | $| [ \t\n\x0b\x0c\r]|[\t\n\x0b\x0c\r] |[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}][ \t\n\x0b\x0c\r]"
#: A word with the ASCII white space before it, or white space at the end of a text.
_UNIT = re.compile(rb"\s*\S+|\s+")
#: Other white space, in UTF-8, before ASCII white space: there the end of a word is no safe place to cut.
_UNSAFE = re.compile(rb"(?:[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf)\s")

#: A word that may be encoded with others in one text: a space before it and no white space, or what counts as such, in it.
_PLAIN = r"^ [^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]+$"
#: How many of them at a time.
JOINED = 64

#: What byte-level tokenizers part within a word, by the bytes of UTF-8: letters (U+00C0 to U+017F among them, but for two signs), digits, other signs,
#: line feeds and spaces. Bytes of class 0 say that a word is left whole: other characters, and the apostrophe, which takes letters with it.
LETTER, DIGIT, SIGN, FEED, SPACE = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = SIGN
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTER
_CLASS[0x30:0x3A], _CLASS[0x27], _CLASS[0x0A], _CLASS[0x20] = DIGIT, 0, FEED, SPACE

#: The byte alphabet of byte-level vocabularies: the sign of each byte in UTF-8, of one byte or two.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = dict(zip([*_PRINTABLE, *sorted({*range(256)} - {*_PRINTABLE})], [*_PRINTABLE, *range(0x100, 0x200)], strict=False))
_SIGN_BYTES = np.array([len(chr(_ALPHABET[b]).encode()) for b in range(256)])
_SIGNS = np.array([list(chr(_ALPHABET[b]).encode().ljust(2)) for b in range(256)], np.uint8)

#: Words in a Python worker's memory, those of the latest blocks, and the bytes of the longest of them; about 50 bytes a word.
MAX_WORDS = 400_000
MAX_WORD_BYTES = 64
#: Texts that come together are cut into blocks of about so many bytes.
BLOCK_BYTES = 6 << 20


class Spans(NamedTuple):
    """Ids of words: those of word i are ids[begins[i] : begins[i] + sizes[i]]."""

    ids: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray

    def of(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at the places, one after the other."""
        each = self.sizes[places]
        until = np.cumsum(each)
        total = int(until[-1]) if len(until) else 0
        kind = np.int32 if total + len(self.ids) < 1 << 31 else np.int64
        index = np.repeat((self.begins[places] - (until - each)).astype(kind), each)
        index += np.arange(total, dtype=kind)
        return self.ids[index]

    def only(self, places: np.ndarray) -> Spans:
        sizes = self.sizes[places]
        return Spans(self.of(places), np.cumsum(sizes) - sizes, sizes)

    def then(self, other: Spans) -> Spans:
        return Spans(np.concatenate([self.ids, other.ids]), np.concatenate([self.begins, other.begins + len(self.ids)]), np.concatenate([self.sizes, other.sizes]))


def spans(lists: list[list[int]]) -> Spans:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return Spans(np.fromiter(chain.from_iterable(lists), "<u4", int(sizes.sum())), np.cumsum(sizes) - sizes, sizes)


class Cuts(NamedTuple):
    """Where a byte-level tokenizer cuts words: their bytes, where each begins and ends, at which bytes it is cut, and which are known to be cut at no others."""

    raw: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    cut: np.ndarray
    sure: np.ndarray


def cuts(words: pa.Array) -> Cuts:
    """A word is cut between characters of different classes; a space stays with what follows.

    Not sure is one with a character of no class, with a space but at its begin, or with a line feed but between two others; it is left whole.
    """
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    begins, ends = edges[:-1], edges[1:]
    kinds = _CLASS[raw]
    outer = np.zeros(len(raw) + 1, bool)
    outer[edges] = True
    cut = np.zeros(len(raw), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:])
    cut[1:] &= kinds[:-1] != SPACE
    cut &= ~outer[:-1]
    bad = kinds == 0
    bad |= (kinds == SPACE) & ~outer[:-1]
    blank, feeds = np.append(kinds >= FEED, True), np.flatnonzero(kinds == FEED)
    bad[feeds] |= outer[feeds] | outer[feeds + 1] | blank[feeds - 1] | blank[feeds + 1]
    lead = np.flatnonzero(raw == 0xC3)
    bad[lead] |= np.isin(raw[lead + 1], (0x97, 0xB7))  # signs among the letters
    faults = np.concatenate([[0], np.cumsum(bad)])
    sure = faults[ends] == faults[begins]
    if not sure.all():
        cut &= np.repeat(sure, ends - begins)
    return Cuts(raw, begins, ends, cut, sure)


def _counts(found: Cuts) -> np.ndarray:
    """The number of pieces of each word."""
    within = np.concatenate([[0], np.cumsum(found.cut)])
    return 1 + within[found.ends] - within[found.begins]


def pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of words, those of one word after those of another, and their number in each."""
    found = cuts(words)
    counts = _counts(found)
    offsets = np.empty(int(counts.sum()) + 1, np.int32)
    first = np.zeros(len(offsets), bool)
    first[np.cumsum(counts) - counts] = first[-1] = True
    offsets[first], offsets[~first] = np.append(found.begins, len(found.raw)), np.flatnonzero(found.cut)
    return pa.StringArray.from_buffers(len(counts) and len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(found.raw)), counts


class Encoder:
    """Gives texts' ids as unsigned 32-bit integers; added tokens' strings are plain text, or get their own ids with `special`."""

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = not special
        added = [re.escape(t.content) for t in self.plain.get_added_tokens_decoder().values()] if special else []
        #: Texts with what this finds, in any case if words are made small, are encoded whole.
        self.added = "|".join(sorted(added, key=len, reverse=True))
        self.has_added = re.compile(self.added, re.IGNORECASE).search
        self.vocab_size = self.plain.get_vocab_size()
        self.drops_space = self._whole(" a\n\nb ") == self._whole("a b")
        self.drops_case = self._whole("AbC") == self._whole("abc")
        # A byte-level vocabulary writes a space as this sign: a piece that begins with it begins a word.
        self.opens = np.array([(self.plain.id_to_token(i) or "").startswith("\u0120") for i in range(self.vocab_size)])
        self.joins = not self.drops_space and self._whole(" ab cd") == self._whole(" ab") + self._whole(" cd")
        how = self.plain.pre_tokenizer
        how = json.loads(how.__getstate__()) if how is not None and self.plain.normalizer is None else {}
        self.parts_words = how.get("type") == "ByteLevel" and how["use_regex"] and not how["add_prefix_space"]
        if self.parts_words:
            #: The same model over texts that are cut and written in the byte alphabet already.
            self.bare = Tokenizer(self.plain.model)
            self.bare.pre_tokenizer = WhitespaceSplit()
            self.n_bytes = np.array([len(self.plain.id_to_token(i) or "") for i in range(self.vocab_size)])
        self.words, self.known = pa.array([], pa.string()), spans([])

    def _whole(self, text: str) -> bytes:
        return array("I", self.plain.encode(text, add_special_tokens=False).ids).tobytes()

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, units: pa.Array) -> Spans:
        """The ids of each word."""
        if not self.parts_words:
            return self._encode_joined(units)
        found = cuts(units)
        alone = found.sure & (_counts(found) == 1)
        made, rest = self._encode_alone(units.filter(pa.array(alone))), self._encode_joined(units.filter(pa.array(~alone)))
        both, places = made.then(rest), np.empty(len(units), np.int64)
        places[np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])] = np.arange(len(units))
        return Spans(both.ids, both.begins[places], both.sizes[places])

    def _encode_alone(self, units: pa.Array) -> Spans:
        """The ids of pieces that no tokenizer's pattern need cut; many in one text, told apart by the bytes of the ids' tokens."""
        found = cuts(units)
        width = _SIGN_BYTES[found.raw]
        signs = _SIGNS[found.raw][np.arange(2) < width[:, None]]
        until = np.concatenate([[0], np.cumsum(width)])[np.append(found.begins, len(found.raw))]
        text = np.insert(signs, until[1:], np.uint8(0x20)).tobytes()
        places = (until + np.arange(len(until))).tolist()
        edges = [*range(0, len(units), JOINED), len(units)]
        texts = [text[places[a] : places[b]].decode() for a, b in zip(edges, edges[1:], strict=False)]
        lists = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(lists), "<u4", sum(map(len, lists)))
        reached = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        until = np.searchsorted(reached, found.ends, "right") - 1
        if reached[-1] != len(found.raw) or (reached[until] != found.ends).any():  # a vocabulary without some byte
            return spans(self._lists(_strings(units)))
        sizes = np.diff(until, prepend=0)
        return Spans(ids, until - sizes, sizes)

    def _encode_joined(self, units: pa.Array) -> Spans:
        """The ids of each word; many words in one text where the ids themselves say which begins where."""
        if not self.joins:
            return spans(self._lists(_strings(units)))
        fit = pc.match_substring_regex(units, _PLAIN).to_numpy(zero_copy_only=False)
        plain, others = _strings(units.filter(pa.array(fit))), _strings(units.filter(pa.array(~fit)))
        groups = range(0, len(plain), JOINED)
        made = spans(self._lists(["".join(plain[k : k + JOINED]) for k in groups]))
        # A group's words are told apart if as many pieces as it has words begin one, the first of them at its begin.
        marks = self.opens[made.ids]
        before = np.concatenate([[0], np.cumsum(marks)])
        due = np.minimum(JOINED, len(plain) - np.arange(0, len(plain), JOINED))
        clear = (before[made.begins + made.sizes] - before[made.begins] == due) & marks[made.begins]
        if not clear.all():
            parts = [made.only(np.flatnonzero(clear))]
            for g in np.flatnonzero(~clear).tolist():
                others += plain[JOINED * g : JOINED * (g + 1)]
            made, marks = parts[0], self.opens[parts[0].ids]
        begins = np.flatnonzero(marks)
        apart = Spans(made.ids, begins, np.diff(begins, append=len(made.ids)))
        # Words of clear groups stand first, then those that don't fit, then those of other groups.
        joined, single = np.flatnonzero(fit), np.flatnonzero(~fit)
        told = np.repeat(clear, due)
        order = np.concatenate([joined[told], single, joined[~told]])
        out = apart.then(spans(self._lists(others)))
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        return Spans(out.ids, out.begins[places], out.sizes[places])

    def _ids_of(self, words: pa.Array) -> Spans:
        """The ids of distinct words."""
        if not self.parts_words or not len(words):
            return self._ids_of_units(words)
        parts, counts = pieces(words)
        numbered = parts.dictionary_encode()
        found, places = self._ids_of_units(numbered.dictionary), numbered.indices.to_numpy()
        sizes = np.add.reduceat(found.sizes[places], np.cumsum(counts) - counts)
        return Spans(found.of(places), np.cumsum(sizes) - sizes, sizes)

    def _ids_of_units(self, units: pa.Array) -> Spans:
        """The ids of distinct words or pieces; those of the latest blocks are kept in mind."""
        at = pc.index_in(units, value_set=self.words)
        missing = at.is_null()
        new = units.filter(missing)
        both = self.known.then(self.encode_words(new))
        fresh = missing.to_numpy(zero_copy_only=False)
        places = at.fill_null(0).to_numpy().astype(np.int64)
        places[fresh] = len(self.words) + np.arange(len(new))
        unused = np.ones(len(self.words), bool)
        unused[places[~fresh]] = False
        short = np.flatnonzero(pc.binary_length(units).to_numpy() <= MAX_WORD_BYTES)[:MAX_WORDS]
        rest = np.flatnonzero(unused)[: MAX_WORDS - len(short)]
        self.words, self.known = pa.concat_arrays([units.take(pa.array(short)), self.words.take(pa.array(rest))]), both.only(np.concatenate([places[short], rest]))
        return Spans(both.ids, both.begins[places], both.sizes[places])

    def _cut(self, text: str) -> list[str] | None:
        """The words of a text that isn't cut at its spaces; nothing if no place in it is safe."""
        raw = text.encode()
        if _UNSAFE.search(raw) or self.added and self.has_added(text):
            return None
        return [u.decode() for u in _UNIT.findall(raw)]

    def _block(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, self.added, ignore_case=self.drops_case).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        if self.drops_space:
            regular = pc.if_else(odd, "", texts) if odd.any() else texts
            cut = pc.ascii_split_whitespace(pc.ascii_lower(regular) if self.drops_case else regular)
        else:
            odd = odd | pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
            cut = pc.split_pattern(pc.if_else(odd, "", texts) if odd.any() else texts, " ")
        flat = pc.list_flatten(cut).dictionary_encode()
        units = [flat.dictionary.cast(pa.string())]
        places = flat.indices.to_numpy().astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())]).astype(np.int64)
        if not self.drops_space:  # all but a text's first word have their space
            first = pc.take(pc.list_flatten(cut), pa.array(offsets[:-1])).dictionary_encode()
            places[offsets[:-1]] = first.indices.to_numpy() + len(units[0])
            units = [pc.binary_join_element_wise(" ", units[0], ""), first.dictionary.cast(pa.string())]
        # Irregular texts stand as one more word each, and the end id as the last.
        own = np.flatnonzero(odd)
        others = [texts[int(i)].as_py() for i in own]
        cuts = [self._cut(t) for t in others]
        more = pa.array(list(chain.from_iterable(c or [] for c in cuts)), pa.string()).dictionary_encode()
        before, at, number = sum(map(len, units)), more.indices.to_numpy(), 0
        words = self._ids_of(pa.concat_arrays([*units, more.dictionary]))
        parts = []
        for text, c in zip(others, cuts, strict=True):
            parts.append(np.frombuffer(self._whole(text), "<u4") if c is None else words.of(before + at[number : number + len(c)]))
            number += len(c or [])
        n = len(words.sizes)
        sizes = np.fromiter(map(len, [*parts, [end]]), np.int64, len(parts) + 1)
        words = words.then(Spans(np.concatenate([*parts, np.array([end], "<u4")]), np.cumsum(sizes) - sizes, sizes))
        places[offsets[own]] = n + np.arange(len(own))
        places = np.insert(places, offsets[1:], n + len(own))
        starts = offsets[:-1] + np.arange(len(texts))
        return words.of(places), np.add.reduceat(words.sizes[places], starts)

    def blocks(self, texts: pa.Array, end: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of texts before, ids one text after the other, ids in each text) of blocks of texts; every text's ids end with `end`."""
        filled = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        total = int(filled[-1]) if len(filled) else 0
        filled = filled * max(1, round(total / block_bytes)) // (total + 1)
        edges = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield a, *self._block(texts.slice(a, b - a), end)
        give_back()


def give_back() -> None:
    """Returns what Arrow and Python have freed to the system after a batch: a worker that waits would hold it beside what later stages need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker; it lasts from task to task. Its ids are the library's by default."""
    return Encoder(path, special=True)
