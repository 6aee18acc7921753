"""A content-addressed store of token ids.

Encoding and cutting happen in one pass: a rolling hash over each document's ids marks the ends of chunks, so equal
passages give equal chunks wherever they stand. A chunk's address is the SHA-256 of its ids as the file holds them.
The store is a folder of four tables:

- chunks(chunk, n, ids): every distinct chunk once; ids are little-endian, `width` bytes each (2 or 4 by vocabulary);
- recipes(slice, place, doc_id, start, n_tokens, chunks, root): one row a document in ascending id order, in a folder for each slice, with the addresses
  of its chunks in order, the ids of all documents before it, and the Merkle root of the addresses;
- manifest(level, node, hash): a Merkle tree over the recipes in that order (root, id, start and number of ids of each), FAN_OUT children to a node;
- format(width, end_id, fan_out): one row.

Only chunks that a Bloom filter takes for repeats are shuffled to be stored once; others go from their task to the
file. Reading checks the recipes against the tree first, and raises ValueError if one is lost, changed or exchanged; then every chunk against its address and every
recipe against its root.

Defined results: a null text is empty and has the end id alone; null ids come first; rows with the same id have a
recipe each, in the order of their roots; an empty table gives empty tables; other columns are never read. A very long text is encoded whole by one task, which holds it and its ids.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bloom
from furrow.llm.common import materialize, ranged, running_totals, small_batches, whole_text
from furrow.llm.tokens import encoder

#: Ids in a chunk: none but a document's last is shorter than MIN_CHUNK, none longer than MAX_CHUNK; beyond MIN_CHUNK one place in MEAN_CHUNK ends it.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 64, 256, 2048
#: The rolling hash sees so many ids; no more than MIN_CHUNK.
WINDOW = 16
FAN_OUT = 1024
RECIPES = "slice int, place long, doc_id long, start long, n_tokens long, chunks array<binary>, root binary"
ENCODED = "doc_id long, n_tokens long, root binary, n_chunks int, chunks array<binary>, ids array<binary>"


def rolling(ids: np.ndarray) -> np.ndarray:
    """At every place a hash of the WINDOW ids up to it."""
    x = ids.astype(np.uint64)
    x += np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    width = 1
    while width < WINDOW:
        x[width:] += x[:-width] * np.uint64(pow(3, width, 1 << 64))
        width *= 2
    return x


def chunk_ends(ids: np.ndarray, counts: np.ndarray) -> Iterator[list[int]]:
    """For each of the documents whose ids follow one another, the places where its chunks end.

    Nothing before MIN_CHUNK ids ends a chunk, so the hash there has seen ids of its own document only.
    """
    marks = (np.flatnonzero(rolling(ids) >> np.uint64(32) < np.uint64((1 << 32) // MEAN_CHUNK)) + 1).tolist()
    begin = at = 0
    for stop in np.cumsum(counts).tolist():
        ends = []
        while begin < stop:
            while at < len(marks) and marks[at] - begin < MIN_CHUNK:
                at += 1
            begin = min(stop, begin + MAX_CHUNK, marks[at] if at < len(marks) else stop)
            ends.append(begin)
        yield ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last node rises as it is. No leaves: the hash of nothing."""
    level = leaves or [hashlib.sha256().digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encode(docs: DataFrame, tokenizer: str, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document, with the addresses of its chunks and their ids."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = encoder(tokenizer).blocks
        for batch in batches:
            for first, ids, counts in blocks(batch.column(1), end_id):
                raw = ids.astype(kind).tobytes()
                roots, offsets, chunks, parts, begin = [], [0], [], [], 0
                for ends in chunk_ends(ids, counts):
                    own = []
                    for stop in ends:
                        part = raw[width * begin : width * stop]
                        own.append(hashlib.sha256(part).digest())
                        parts.append(part)
                        begin = stop
                    chunks += own
                    offsets.append(len(chunks))
                    roots.append(merkle_root(own))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.binary())) for values in (chunks, parts)]
                heads = [batch.column(0).slice(first, len(counts)), pa.array(counts, pa.int64()), pa.array(roots, pa.binary()), pa.array(np.diff(offsets), pa.int32())]
                yield pa.RecordBatch.from_arrays([*heads, *lists], ["doc_id", "n_tokens", "root", "n_chunks", "chunks", "ids"])

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs, text_col).alias("text"))
    return texts.mapInArrow(run, ENCODED)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def _manifest(recipes: DataFrame) -> DataFrame:
    """Level 0 hashes FAN_OUT recipes a node, and so on up to one node."""
    rest = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens")
    level, nodes = 0, recipes.select("place", F.unhex(F.sha2(F.concat("root", F.encode(rest, "UTF-8")), 256)).alias("hash"))
    out = None
    while True:
        grouped = nodes.groupBy(F.expr(f"place div {FAN_OUT}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("below"))  # FAN_OUT at most
        joined = F.aggregate("below", F.lit(b""), lambda a, x: F.concat(a, x["hash"]))
        made = materialize(grouped.select(F.lit(level).alias("level"), "node", F.unhex(F.sha2(joined, 256)).alias("hash")), "merkle")
        out = made if out is None else out.unionByName(made)
        if made.filter("node > 0").isEmpty():
            return out
        level, nodes = level + 1, made.select(F.col("node").alias("place"), "hash")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of docs to path, a folder that doesn't exist yet."""
    spark = docs.sparkSession
    width = 2 if max(encoder(tokenizer).vocab_size - 1, end_id) < 1 << 16 else 4
    with small_batches(spark):
        encoded = materialize(_encode(docs, tokenizer, end_id, width, id_col, text_col), "encoded")

    addresses = encoded.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("digest"))
    repeats, bits = bloom.repeated(addresses, "digest")
    chunks = encoded.select(F.inline(F.arrays_zip("chunks", "ids"))).select(F.col("chunks").alias("chunk"), (F.octet_length("ids") / width).cast("int").alias("n"), "ids")
    tested = bloom.probe(chunks.withColumn("digest", F.xxhash64("chunk")), "digest", repeats, bits)
    once = tested.filter(~F.col("maybe")).select("chunk", "n", "ids")
    again = tested.filter("maybe").groupBy("chunk").agg(F.first("n").alias("n"), F.first("ids").alias("ids"))
    once.unionByName(again).write.parquet(f"{path}/chunks")

    order = ["doc_id", "root"]
    slim = encoded.select("doc_id", "n_tokens", "root", "chunks")
    placed = running_totals(ranged(slim, order, "recipes"), order, start=F.col("n_tokens"), place=F.lit(1).cast("long"))
    # A folder for each slice, slices and places ascending.
    recipes = placed.select("slice", "place", "doc_id", "start", "n_tokens", "chunks", "root").sortWithinPartitions("slice", "place")
    recipes.write.partitionBy("slice").parquet(f"{path}/recipes")
    _manifest(_recipes(spark, path)).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(width, end_id, FAN_OUT)], "width int, end_id int, fan_out int").write.parquet(f"{path}/format")


@lru_cache(maxsize=1 << 14)
def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes modulo the CRC-32 polynomial, bits reflected."""
    out, power, exponent = 1 << 31, 1 << 30, 8 * n_bytes
    while exponent:
        if exponent & 1:
            out = _times(out, power)
        power, exponent = _times(power, power), exponent >> 1
    return out


def _times(a: int, b: int) -> int:
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crcs(parts: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The CRC-32 of each of several concatenations, from the CRC-32 and bytes of all their parts in order and the number of parts of each."""
    kinds, at = np.unique(sizes, return_inverse=True)
    shifts = np.array([_shift(int(n)) for n in kinds], np.uint32)[at]
    parts, firsts = parts.astype(np.uint32), np.cumsum(counts) - counts
    out = np.zeros(len(counts), np.uint32)
    for k in range(int(counts.max(initial=0))):
        has = np.flatnonzero(counts > k)
        place = firsts[has] + k
        out[has] = _times_all(shifts[place], out[has]) ^ parts[place]
    return out


def _times_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_times for arrays."""
    out, one = np.zeros_like(b), np.uint32(1)
    for bit in range(31, -1, -1):
        out ^= b * (a >> np.uint32(bit) & one)
        b = b >> one ^ np.uint32(0xEDB88320) * (b & one)
    return out


def checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk, n, crc32 (of the ids as 32-bit integers) and ok for every chunk, from its ids in the file."""
    kind = np.dtype(f"<u{spark.read.parquet(f'{path}/format').first()['width']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[column.to_pylist() for column in batch.columns], strict=True))
            crcs = [zlib.crc32(np.frombuffer(i, kind).astype("<u4").tobytes()) for _, _, i in rows]
            ok = [hashlib.sha256(i).digest() == c and len(i) == n * kind.itemsize for c, n, i in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64()), pa.array(ok, pa.bool_())], ["chunk", "n", "crc32", "ok"])

    return spark.read.parquet(f"{path}/chunks").select("chunk", "n", "ids").mapInArrow(run, "chunk binary, n int, crc32 long, ok boolean")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the chunks in the store; verified says that chunks and root agree with their addresses.

    A chunk is read and checked once, however many documents have it; a document's checksum is put together from
    those of its chunks, so ids needn't move.
    """
    if not manifest_holds(spark, path):
        raise ValueError(f"the recipes in {path} don't agree with its manifest")
    recipes = _recipes(spark, path)
    refs = recipes.select("place", F.posexplode("chunks").alias("pos", "chunk"))
    found = refs.join(materialize(checked_chunks(spark, path), "checked"), "chunk", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", "n", "crc32", "chunk", "ok"))).alias("parts")  # a document's own chunks
    per_doc = found.groupBy("place").agg(parts).select(
        "place", F.forall("parts", lambda p: F.coalesce(p["ok"], F.lit(False))).alias("ok"), *[F.transform("parts", _field(n)).alias(n) for n in ("n", "crc32", "chunk")]
    )
    heads = recipes.select("place", "doc_id", "start", "n_tokens", "root")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("chunk")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.fill_null(pc.list_flatten(batch.column("n")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            crcs = pc.fill_null(pc.list_flatten(batch.column("crc32")), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            totals = np.concatenate([[0], np.cumsum(sizes)])
            tokens = totals[ends] - totals[ends - counts]
            chunks = pc.list_flatten(lists).to_pylist()
            roots = [merkle_root(chunks[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            whole = np.array([r == root for r, root in zip(roots, batch.column("root").to_pylist(), strict=True)], bool)
            whole &= batch.column("ok").to_numpy(zero_copy_only=False).astype(bool) & (tokens == batch.column("n_tokens").to_numpy(zero_copy_only=False))
            crc = joined_crcs(crcs, 4 * sizes, counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(tokens), pa.array(crc), pa.array(whole)], names)

    return heads.join(per_doc, "place").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def _field(name: str) -> Callable[[Column], Column]:
    return lambda part: part[name]


def read_ids(spark: SparkSession, path: str, places: DataFrame | None = None) -> DataFrame:
    """place, doc_id and ids (as the file holds them) of all documents, or of those in places(place)."""
    recipes = _recipes(spark, path)
    recipes = recipes if places is None else recipes.join(places, "place", "left_semi")
    refs = recipes.select("place", "doc_id", F.posexplode("chunks").alias("pos", "chunk"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "ids")))
    joined = refs.join(spark.read.parquet(f"{path}/chunks").select("chunk", "ids"), "chunk").groupBy("place", "doc_id").agg(parts.alias("parts"))
    return joined.select("place", "doc_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def manifest_holds(spark: SparkSession, path: str) -> bool:
    """Whether the Merkle tree, made again from the recipes, is the one in the store."""
    again, stored = _manifest(_recipes(spark, path)), spark.read.parquet(f"{path}/manifest")
    return again.exceptAll(stored).isEmpty() and stored.exceptAll(again).isEmpty()
