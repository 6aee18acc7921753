"""How the tokens of two vocabularies overlap in the same texts, and which pairs go together best over the corpus.

1. Texts are taken in chunks of some megabytes. Every place where words are cut ends a token of both vocabularies, so alignment is done once for each distinct
   word of a chunk. A chunk keeps its documents' words, its words' links and, striped by the second vocabulary's ids, its distinct pairs of ids with their numbers of links.
2. The stripes' pairs meet by stripe: np.add.at adds them into a dense block of counts (WIDTH ids of one side by all of the other), whose row maxima are the best counts.
   Blocks are made first by stripe and salt and then by stripe, so that no task reads a stripe of all chunks.
3. The chunks' pairs meet the finished blocks, co-partitioned by stripe and salt, and get their counts, with one bit for the best.
4. The answers return to their chunk, which sums them by word and by document.

Tasks of steps 2 to 4 read their rows in order, one after the other: they hold a block or a chunk, never a partition. What moves is the chunks' distinct pairs, compressed, and the chunks' words.

Defined results: a null or empty text, or one whose tokens' bytes don't give the text again (with a space before it), has no tokens: zeros and an empty string. A document
longer than a chunk is a chunk of its own, held whole by one worker. Rows with the same id, or none, are each counted; an empty table gives no rows; columns other than id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import units
from furrow.llm.common import materialize, n_slices
from furrow.llm.tokens import give_back

#: Ids of the second vocabulary in a stripe: a block is WIDTH x 50,257 x 8 bytes, 51 MB, for the vocabularies used here.
WIDTH = 128
#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
#: Distinct words that are aligned at a time.
BLOCK_WORDS = 1 << 15
#: Chunks whose pairs of one stripe meet in a task.
SALT_CHUNKS = 4096

_CHUNKS = """chunk long, stripe int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,
    n_words array<int>, words binary, word_links binary, links binary, pairs binary, counts binary"""
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed bytes: their number and, plane by plane, their bytes from the lowest up."""
    wide = values.astype("<u8")
    planes = max(1, (int(wide.max()).bit_length() + 7) // 8) if len(wide) else 1
    raw = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return len(wide).to_bytes(8, "little") + bytes([planes]) + pa.compress(raw, "zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    n, planes = int.from_bytes(raw[:8], "little"), raw[8]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :planes] = np.frombuffer(pa.decompress(raw[9:], n * planes, "zstd"), np.uint8).reshape(planes, n).T
    return wide.view("<u8")[:, 0].astype(np.int64)


class Aligned(NamedTuple):
    """Of each word: numbers of tokens, groups and links, its groups as text, whether its tokens give its bytes; the links' keys (b * size_a + a) one word after the other."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    whole: np.ndarray
    links: np.ndarray


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over runs of the given lengths, empty ones too."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Aligner:
    """Aligns distinct words by two vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = units.byte_level(path_a), units.pieces(path_b)
        self.size_a, self.size_b = self.a.size, self.b.size
        self.long_a, self.long_b = (np.fromiter(map(len, v.bytes), np.int64) for v in (self.a, self.b))
        most = max(self.size_a, self.size_b)
        signed = [f"{i}{sign}".encode() for i in range(most) for sign in (",", "|", ";")]
        self.signs = np.frombuffer(b"".join(signed), np.uint8)
        self.sign_sizes = np.fromiter(map(len, signed), np.int64, len(signed))
        self.sign_starts = np.cumsum(self.sign_sizes) - self.sign_sizes

    def _written(self, found: units.Tokens, vocabulary: list[bytes], words: list[str]) -> np.ndarray:
        """Whether each word's tokens have the word's bytes."""
        parts = list(map(vocabulary.__getitem__, found.ids.tolist()))
        edges = np.concatenate([[0], np.cumsum(found.counts)]).tolist()
        return np.fromiter((b"".join(parts[s:e]) == w.encode() for (s, e), w in zip(pairwise(edges), words, strict=True)), bool, len(words))

    def align(self, words: list[str]) -> Aligned:
        """A block of words after the other, which bounds what is held beside the result."""
        parts = [self._block(words[k : k + BLOCK_WORDS]) for k in range(0, max(1, len(words)), BLOCK_WORDS)]
        return Aligned(*[list(chain.from_iterable(c)) if name == "groups" else np.concatenate(c) for name, c in zip(Aligned._fields, zip(*parts, strict=True), strict=True)])

    def _block(self, words: list[str]) -> Aligned:
        a, b = self.a.encode(words), self.b.encode(words)
        whole = self._written(a, self.a.bytes, words) & self._written(b, self.b.bytes, words)
        a_ids, b_ids = a.ids[np.repeat(whole, a.counts)], b.ids[np.repeat(whole, b.counts)]
        n_a, n_b = np.where(whole, a.counts, 0), np.where(whole, b.counts, 0)
        # Both vocabularies' tokens tile the same bytes: the words that are whole, one after the other.
        end_a, end_b = np.cumsum(self.long_a[a_ids]), np.cumsum(self.long_b[b_ids])
        place = np.searchsorted(end_b, end_a)
        shared_a = np.zeros(len(end_a), bool)
        shared_a[place < len(end_b)] = end_b[place[place < len(end_b)]] == end_a[place < len(end_b)]
        shared_b = np.zeros(len(end_b), bool)
        shared_b[place[shared_a]] = True
        # Every stretch between two ends lies in one token of either side: a link.
        ends = np.union1d(end_a, end_b)
        links = b_ids[np.searchsorted(end_b, ends)] * self.size_a + a_ids[np.searchsorted(end_a, ends)]
        n_groups = _sums(shared_a.astype(np.int64), n_a)
        return Aligned(n_a, n_b, n_groups, n_a + n_b - n_groups, self._texts(a_ids, b_ids, shared_a, shared_b, n_a + n_b), whole, links)

    def _texts(self, a_ids: np.ndarray, b_ids: np.ndarray, shared_a: np.ndarray, shared_b: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Each word's groups as `a1,a2|b1;a3|b2,b3`: numbers with the sign after them, laid one after the other."""
        b_until, a_until = np.cumsum(shared_b), np.cumsum(shared_a)
        ends_a, ends_b = np.flatnonzero(shared_a) + 1, np.flatnonzero(shared_b) + 1  # tokens until the end of each group
        before_b = np.concatenate([[0], ends_b])[a_until - shared_a]  # tokens of b in the groups before a token's own
        to_a = ends_a[b_until - shared_b] if len(ends_a) else np.zeros(0, np.int64)
        coded = np.empty(len(a_ids) + len(b_ids), np.int64)
        coded[np.arange(len(a_ids)) + before_b] = 3 * a_ids + shared_a
        coded[np.arange(len(b_ids)) + to_a] = 3 * b_ids + 2 * shared_b
        each = self.sign_sizes[coded]
        until = np.cumsum(each)
        index = np.repeat(self.sign_starts[coded] - (until - each), each)
        index += np.arange(len(index))
        raw = self.signs[index].tobytes()
        edges = np.concatenate([[0], until])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [raw[s : e - 1] if e > s else b"" for s, e in pairwise(edges)]


def _lists(**columns: list) -> pa.RecordBatch:
    """One row of the chunks' table."""
    kinds = {"chunk": pa.int64(), "stripe": pa.int32(), "n_words": pa.list_(pa.int32()), "groups_sha256": pa.list_(pa.string())}
    kinds |= dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links"), pa.list_(pa.int64())) | dict.fromkeys(("words", "word_links", "links", "pairs", "counts"), pa.binary())
    names = [c.split()[0] for c in _CHUNKS.replace("\n", " ").split(",")]
    rows = max(map(len, columns.values()))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[n]) if n in columns else pa.nulls(rows, kinds[n]) for n in names], names)


def _chunk(number: int, aligner: Aligner, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """A chunk's row, and a row for each of its stripes."""
    n = len(texts)
    filled = np.flatnonzero(pc.binary_length(texts).to_numpy() > 0)
    found = units.cut(texts.take(pa.array(filled)))
    aligned = aligner.align(found.words)
    n_words = np.diff(found.starts)
    good = _sums((~aligned.whole[found.places]).astype(np.int64), n_words) == 0
    places = found.places[np.repeat(good, n_words)]
    kept, n_kept = filled[good], n_words[good]

    def by_document(values: np.ndarray) -> list[int]:
        out = np.zeros(n, np.int64)
        out[kept] = _sums(values[places], n_kept)
        return out.tolist()

    digests = [""] * n
    parts, at = list(map(aligned.groups.__getitem__, places.tolist())), 0
    for doc, size in zip(kept.tolist(), n_kept.tolist(), strict=True):
        digests[doc] = hashlib.sha256(b";".join(parts[at : at + size])).hexdigest()
        at += size

    times = np.repeat(np.bincount(places, minlength=len(found.words)), aligned.n_links)
    keys, link = np.unique(aligned.links, return_inverse=True)
    counts = np.bincount(link, weights=times, minlength=len(keys)).astype(np.int64)  # exact: far fewer than 2^53
    order = np.argsort(keys // aligner.size_a % _stripes(aligner.size_b), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, counts = keys[order], counts[order]
    all_words = np.zeros(n, np.int32)
    all_words[kept] = n_kept
    yield _lists(
        chunk=[number], stripe=[-1], doc_id=[ids.to_pylist()], n_a=[by_document(aligned.n_a)], n_b=[by_document(aligned.n_b)], n_groups=[by_document(aligned.n_groups)], n_links=[by_document(aligned.n_links)],
        groups_sha256=[digests], n_words=[all_words.tolist()], words=[_pack(places)], word_links=[_pack(aligned.n_links)], links=[_pack(rank[link])],
    )
    stripe, begins = np.unique(keys // aligner.size_a % _stripes(aligner.size_b), return_index=True)
    edges = [*begins.tolist(), len(keys)]
    cuts = list(pairwise(edges)) if len(stripe) else []
    yield _lists(chunk=[number] * len(cuts), stripe=stripe.tolist(), pairs=[_pack(np.diff(keys[s:e], prepend=0)) for s, e in cuts], counts=[_pack(counts[s:e]) for s, e in cuts])


def _stripes(size_b: int) -> int:
    """Ids are dealt to stripes in turn: frequent ones have low numbers, and shouldn't share a stripe."""
    return -(-size_b // WIDTH)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _add_up(size_a: int, size_b: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of (stripe, salt): each run's pairs are added into a dense block, and leave with their counts and whether they are the most of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = _stripes(size_b)
        block, own = np.zeros((WIDTH, size_a), np.int64), None
        flat = block.reshape(-1)

        def finished() -> pa.RecordBatch:
            places = np.flatnonzero(flat)
            counts = flat[places]
            best = block.max(axis=1)[places // size_a] == counts
            keys = (places // size_a * stripes + own[0]) * size_a + places % size_a
            flat[places] = 0
            row = [pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int32()), *(pa.array([_pack(v)], pa.binary()) for v in (np.diff(keys, prepend=0), counts, best))]
            return pa.RecordBatch.from_arrays(row, ["stripe", "salt", "pairs", "counts", "best"])

        for row in _rows(batches):
            if own is not None and own != (row["stripe"], row["salt"]):
                yield finished()
            own = row["stripe"], row["salt"]
            keys = np.cumsum(_unpack(row["pairs"]))
            np.add.at(flat, keys // size_a // stripes * size_a + keys % size_a, _unpack(row["counts"]))
        if own is not None:
            yield finished()
        give_back()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (stripe, salt), the block first: each chunk's pairs get 2 x count, and one more where the count is the best."""
    keys = values = np.zeros(0, np.int64)
    for row in _rows(batches):
        if row["chunk"] is None:
            keys, values = np.cumsum(_unpack(row["pairs"])), 2 * _unpack(row["counts"]) + _unpack(row["best"])
        else:
            asked = values[np.searchsorted(keys, np.cumsum(_unpack(row["pairs"])))]
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([row["stripe"]], pa.int32()), pa.array([_pack(asked)], pa.binary())], ["chunk", "stripe", "answers"])
    give_back()


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (chunk, stripe), the chunk first and its answers after it, in the order of its pairs."""

    def finished() -> pa.RecordBatch:
        links = np.concatenate([*answers, np.zeros(0, np.int64)])[_unpack(chunk["links"])]
        of_word, words, n_words = _unpack(chunk["word_links"]), _unpack(chunk["words"]), np.array(chunk["n_words"], np.int64)
        best, total = (_sums(_sums(v, of_word)[words], n_words) for v in (links & 1, links >> 1))
        given = [pa.array(chunk[n], pa.string() if n == "groups_sha256" else pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
        return pa.RecordBatch.from_arrays([*given[:5], pa.array(best), pa.array(total), given[5]], [c.split()[0] for c in _RESULT.split(", ")])

    chunk, answers = None, []
    for row in _rows(batches):
        if row["stripe"] >= 0:
            answers.append(_unpack(row["answers"]))
            continue
        if chunk is not None:
            yield finished()
        chunk, answers = row, []
    if chunk is not None:
        yield finished()
    give_back()


def _meeting(df: DataFrame, keys: list[str], then: list[str]) -> DataFrame:
    """Rows with the same keys in one partition, in order."""
    return df.repartition(n_slices(df), *keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_first() for c in then])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    path_a is a byte-level vocabulary of the tokenizers library, path_b a SentencePiece model; both are encoded with a space before the text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in units.blocks(batch.column(1), chunk_bytes):
                yield from _chunk(number, aligner, batch.column(0).slice(first, len(texts)), texts)
                number += 1
            give_back()

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    chunks = materialize(texts.mapInArrow(encode, _CHUNKS), "aligned-chunks")
    size_a, size_b = units.byte_level(path_a).size, units.pieces(path_b).size
    salts = 1 + chunks.filter("stripe = -1").count() // SALT_CHUNKS
    asked = chunks.filter("stripe >= 0").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))

    block = "stripe int, salt int, pairs binary, counts binary, best binary"
    add_up = _add_up(size_a, size_b)
    salted = _meeting(asked.select("stripe", "salt", "pairs", "counts"), ["stripe", "salt"], []).mapInArrow(add_up, block)
    whole = _meeting(salted.select("stripe", F.lit(0).alias("salt"), "pairs", "counts"), ["stripe"], []).mapInArrow(add_up, block)
    blocks = materialize(whole, "pair-blocks").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    both = asked.select("chunk", "stripe", "salt", "pairs", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"))
    both = both.unionByName(blocks.select(F.lit(None).cast("long").alias("chunk"), "stripe", "salt", "pairs", "counts", "best"))
    answers = _meeting(both, ["stripe", "salt"], ["chunk"]).mapInArrow(_answer, "chunk long, stripe int, answers binary")

    own = chunks.filter("stripe = -1").drop("pairs", "counts").withColumn("answers", F.lit(None).cast("binary"))
    returned = own.unionByName(answers, allowMissingColumns=True)
    return _meeting(returned, ["chunk"], ["stripe"]).mapInArrow(_score, _RESULT)
