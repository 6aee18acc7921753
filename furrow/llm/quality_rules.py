"""Quality rules by a tokenizer's fertility.

A public vocabulary made from ordinary text cuts ordinary text into few, long and varied tokens. Per document three figures are measured with it: characters per token, the share of tokens that
are single bytes for want of a piece (white space apart), and the entropy of the tokens in bits. They depend on the language, and on the length of a text. For each language and size class (powers of two of tokens) the quartiles
of the figures over the whole corpus give a band: so many times the distance of the quartiles beyond both. A document outside one of its bands is rejected. Figures that are the same in all count once for the
quartiles, so that many copies of a text don't make a band of their own.

One pass measures (distinct words of a block of texts are encoded once, see units); the quartiles come from sketches that tasks fill and that are merged, so a language with most of the rows is no hot group. The bands
meet the figures by a broadcast where there are at most MOST_BANDS of them (some 25 for each language), and by an ordinary join beyond that.

Base figures: words, code points in words, symbols, lines that repeat an earlier one, words in windows of five that come twice or more.

Defined results: a null text has no words, an empty one neither, and both fail the base rules. Rows without a language are a group. A text is measured whole, however long: one worker holds it and its words. Repeated rows are
measured each; an empty table gives no rows; columns other than id, text and group are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import units
from furrow.llm.common import materialize
from furrow.llm.tokens import give_back

BLOCK_BYTES = 4 << 20
#: A band's row has some 100 bytes: at most 2 MB are broadcast.
MOST_BANDS = 20_000
#: Words in a window.
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"

_MEASURES = """doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    n_chars long, n_tokens long, n_bytes long, entropy double"""


class Rules(NamedTuple):
    """Base rules, and bands that reach `width` times the distance of the quartiles (or the least distance named) beyond them. A class of fewer than `least_texts` different figures has no bands: too little is known of it."""

    least_words: int = 10
    most_repeated: int = 20
    width: float = 2.0
    fertility: float = 0.05
    byte_share: float = 0.01
    entropy: float = 0.15
    least_texts: int = 30


def _of_documents(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of marked bytes of each text."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_IS_SPACE, _IS_SYMBOL = _table(_SPACES), _table(SYMBOLS)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, text) of every word."""
    inside = ~_IS_SPACE[raw]
    before = np.concatenate([[False], inside[:-1]])
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    first = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    last = np.flatnonzero(inside & ~after) + 1
    return first, last, np.searchsorted(offsets, first, side="right") - 1


def _repeated(words: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """For each text the words that lie in a window found twice or more in it; windows are ranked step by step, so that equal ranks are equal windows."""
    covered = np.zeros(len(words) + 1, np.int64)
    first = np.flatnonzero(text[: max(0, len(words) - WINDOW + 1)] == text[WINDOW - 1 :])  # windows within a text
    if len(first):
        different = np.int64(words.max() + 1)
        rank = text[first]
        for k in range(WINDOW):
            rank = np.unique(rank * different + words[first + k], return_inverse=True)[1]
        twice = first[np.bincount(rank)[rank] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    return np.bincount(text[np.cumsum(covered[:-1]) > 0], minlength=n_texts)


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    lines = pc.split_pattern(texts, "\n")
    flat = pc.list_flatten(lines).dictionary_encode()
    text = pc.list_parent_indices(lines).to_numpy().astype(np.int64)
    worded = pc.match_substring_regex(flat.dictionary, r"[^ \t\n\x0b\x0c\r]").to_numpy(zero_copy_only=False)
    codes = flat.indices.to_numpy().astype(np.int64)
    keep = worded[codes] if len(codes) else np.zeros(0, bool)
    text, codes = text[keep], codes[keep]
    distinct = np.unique(text * (len(worded) + 1) + codes)
    return np.bincount(text, minlength=len(texts)) - np.bincount(distinct // (len(worded) + 1), minlength=len(texts))


def _tokens(texts: pa.Array, model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, byte tokens, entropy in bits) of each text."""
    n = len(texts)
    counts, fallen, entropy = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    filled = np.flatnonzero(pc.binary_length(texts).to_numpy() > 0)
    if not len(filled):
        return counts, fallen, entropy
    vocabulary = units.pieces(model)
    found = units.cut(texts.take(pa.array(filled)))
    known = vocabulary.encode(found.words)
    begins, each = (np.cumsum(known.counts) - known.counts)[found.places], known.counts[found.places]
    until = np.cumsum(each)
    ids = known.ids[np.repeat(begins - (until - each), each) + np.arange(until[-1])]
    ends = np.concatenate([[0], until])[found.starts]
    text = np.repeat(np.arange(len(filled)), np.diff(ends))
    total = np.diff(ends)
    key, times = np.unique(text * vocabulary.size + ids, return_counts=True)
    logs = np.bincount(key // vocabulary.size, weights=times * np.log2(times), minlength=len(filled))
    counts[filled], entropy[filled] = total, np.maximum(np.log2(total) - logs / total, 0)
    fallen[filled] = np.bincount(text, weights=vocabulary.falls_back[ids], minlength=len(filled)).astype(np.int64)
    return counts, fallen, entropy


def _measured(ids: pa.Array, band: pa.Array, texts: pa.Array, model: str) -> pa.RecordBatch:
    texts = pa.concat_arrays([texts])  # offsets from the first text on
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]).astype(np.int64)
    start = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[start : start + offsets[-1]]
    points = raw & 0xC0 != 0x80  # a byte that isn't a continuation begins a code point
    first, last, text = _words(raw, offsets)
    whole = pa.Array.from_buffers(pa.large_binary(), len(first), [None, *_slices(raw, first, last)])
    words = whole.dictionary_encode().indices.to_numpy().astype(np.int64)
    n_tokens, n_bytes, entropy = _tokens(texts, model)
    columns = [
        np.bincount(text, minlength=len(texts)), _of_documents(points & ~_IS_SPACE[raw], offsets), _of_documents(_IS_SYMBOL[raw], offsets), _repeated_lines(texts),
        _repeated(words, text, len(texts)), _of_documents(points, offsets), n_tokens, n_bytes,
    ]
    names = [c.split()[0] for c in _MEASURES.replace("\n", " ").split(",")]
    return pa.RecordBatch.from_arrays([ids, band, *[pa.array(c.astype(np.int64)) for c in columns], pa.array(entropy)], names)


def _slices(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[pa.Buffer, pa.Buffer]:
    """Offsets and bytes of an array of the given stretches."""
    size = last - first
    until = np.cumsum(size)
    index = np.repeat(first - (until - size), size) + np.arange(until[-1] if len(until) else 0)
    return pa.py_buffer(np.concatenate([[0], until]).astype(np.int64).tobytes()), pa.py_buffer(raw[index].tobytes())


def measure(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", band_col: str = "lang") -> DataFrame:
    """The base figures, tokens, byte tokens and entropy of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in units.blocks(batch.column(2), BLOCK_BYTES):
                yield _measured(batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), texts, model)
            give_back()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[band_col].cast("string").alias("band"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, _MEASURES)


def figures(measures: DataFrame) -> dict[str, Column]:
    """The figures that have bands; of a text without tokens there are none."""
    tokens = measures["n_tokens"]
    return {"fertility": F.try_divide(measures["n_chars"], tokens), "byte_share": F.try_divide(measures["n_bytes"], tokens), "entropy": F.when(tokens > 0, measures["entropy"])}


def bands(measures: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """band, size, and the least and most of each figure, from all measures."""
    found = figures(measures)
    sized = measures.filter("n_tokens > 0").select("band", _size(measures).alias("size"), *[c.alias(n) for n, c in found.items()]).distinct()
    quartiles = [F.percentile_approx(n, [0.25, 0.75], 10_000).alias(n) for n in found]
    spread = {n: rules.width * F.greatest(F.col(n)[1] - F.col(n)[0], F.lit(getattr(rules, n))) for n in found}
    sides = [side for n in found for side in ((F.col(n)[0] - spread[n]).alias(f"{n}_least"), (F.col(n)[1] + spread[n]).alias(f"{n}_most"))]
    return sized.groupBy("band", "size").agg(F.count("*").alias("texts"), *quartiles).filter(F.col("texts") >= rules.least_texts).select("band", "size", *sides)


def _size(measures: DataFrame) -> Column:
    return F.when(measures["n_tokens"] > 0, F.floor(F.log2(measures["n_tokens"].cast("double"))).cast("int"))


def judge(docs: DataFrame, model: str, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", band_col: str = "lang") -> DataFrame:
    """doc_id, the base figures, base_failed, the three figures and kept of every row."""
    measures = materialize(measure(docs, model, id_col, text_col, band_col), "fertility")
    limits = materialize(bands(measures, rules), "fertility-bands")
    n = limits.count()
    found = limits.select(F.col("band").alias("of"), F.col("size").alias("of_size"), *limits.columns[2:])
    meets = measures["band"].eqNullSafe(found["of"]) & (_size(measures) == found["of_size"])
    joined = measures.join(F.broadcast(found) if n <= MOST_BANDS else found, meets, "left")
    own = figures(measures)
    outside = [F.coalesce(~c.between(F.col(f"{n}_least"), F.col(f"{n}_most")), F.lit(False)) for n, c in own.items()]
    base = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return joined.select("doc_id", *counted, base.alias("base_failed"), *[c.alias(n) for n, c in own.items()], (~base & ~(outside[0] | outside[1] | outside[2])).alias("kept"))
