"""Best-fit packing under several capacities at once.

A document's ids are cut only where a sequence ends before them: into pieces of `tokens` ids, the last as long as is left. Pieces
are dealt into groups of about GROUP_PIECES, the number of groups growing with the input, and every group is packed on
its own. With 2,048 tokens, neither 2,048 documents nor an attention cost of 2,048 squared can be exceeded before the tokens are: such limits only weigh in the choice; callers that
want them to decide give smaller ones, as the pipeline does for documents. Pieces go from the longest to the shortest, each into the open sequence that suits it best among all those
with room for it in every capacity (tokens, documents, attention cost as the sum of squared lengths). `norm` takes
the sequence whose residual capacities, weighted, would have the smallest norm; `dot` the one with the largest
weighted dot product of the piece's demands and the residuals. Only a group's last sequences are poorly filled.

Defined results: a null text is empty and gives one piece with the end id alone; rows with the same id are packed
each for itself; an empty table gives no rows; columns other than id and text are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import materialize, whole_text
from furrow.llm.tokens import encoder

GROUP_PIECES = 16_000
#: Texts encoded at a time: what is held beside them is some forty times as much.
BLOCK_BYTES = 6 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; weights say how much each residual counts in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, tokens: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each piece; keep_ids adds its ids as little-endian unsigned 32-bit integers. Smaller blocks take less memory and more time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = encoder(tokenizer).blocks
        for batch in batches:
            docs_of = batch.column(0).to_pylist()
            for first, ids, counts in blocks(batch.column(1), end_id, block_bytes):
                raw, at, out = ids.tobytes(), 0, []
                for doc, count in zip(docs_of[first : first + len(counts)], counts.tolist(), strict=True):
                    for k in range(0, count, tokens):
                        length = min(tokens, count - k)
                        part = raw[4 * (at + k) : 4 * (at + k + length)]
                        out.append((doc, k // tokens, k, length, zlib.crc32(part), *[part] * keep_ids))
                    at += count
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs, text_col).alias("text"))
    return texts.mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """The sequence, from 0, of each piece."""
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    scale = np.asarray(capacity.weights) / limits
    demands = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1)
    if len(lengths) and (demands.max(axis=0) > limits).any():
        raise ValueError("a piece is larger than a sequence")
    chosen = np.empty(len(lengths), dtype=np.int64)
    left = np.empty((len(lengths), 3))  # of the open sequences, in the first `n_open` rows
    number = np.empty(len(lengths), dtype=np.int64)
    n_open = made = 0
    shortest = lengths.min(initial=0)
    for i in np.argsort(-lengths, kind="stable"):
        need = demands[i]
        room = left[:n_open]
        fits = np.flatnonzero((room[:, 0] >= need[0]) & (room[:, 1] >= 1) & (room[:, 2] >= need[2]))
        if len(fits):
            if capacity.rule == "dot":
                score = -(room[fits] * scale) @ (need * scale)
            else:
                score = (((room[fits] - need) * scale) ** 2).sum(axis=1)
            at = fits[np.argmin(score)]
        else:
            at, n_open = n_open, n_open + 1
            left[at], number[at] = limits, made
            made += 1
        left[at] -= need
        chosen[i] = number[at]
        if left[at, 0] < shortest or left[at, 1] < 1 or left[at, 2] < shortest**2:  # nothing fits any more: close it
            n_open -= 1
            left[at], number[at] = left[n_open], number[n_open]
    return chosen


def pack(cut: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces()."""
    stored = materialize(cut, "pieces").withColumn("row_number", F.monotonically_increasing_id())
    groups = max(1, -(-stored.count() // GROUP_PIECES))
    dealt = stored.withColumn("pack_group", F.pmod(F.xxhash64("row_number"), F.lit(groups)))

    def pack_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "row_number"], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        rows["sequence_id"] = best_fit(lengths, capacity)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - lengths
        rows["sequence_id"] += int(key[0]) << 32
        return rows[columns]

    columns = [*cut.columns, "sequence_id", "offset"]
    schema = ", ".join([*(f"{n} {t}" for n, t in cut.dtypes), "sequence_id long", "offset long"])
    return dealt.groupBy("pack_group").applyInPandas(pack_group, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, joined in the order of their offsets; packed needs ids (keep_ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # as many as fit a sequence
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
