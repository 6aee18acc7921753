"""Contiguous shards of near-equal bytes by global prefix sums.

Rows are put in the order of their ids over range partitions; each partition's total gives its offset, and offset
plus running sum gives every row's place on one long line of bytes. The line is cut at equal targets: a row goes to
the shard in which its middle lies. Only one total for each partition meets anywhere; rows never do.

Defined results: a null text has no bytes, but every row has OVERHEAD; null ids come first; rows with the same id
follow the order of their checksum and size (equal ones are interchangeable); an empty table gives no rows; with fewer rows
than shards, some shards stay empty. A document larger than a shard's target makes its shard as much larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import materialize, ranged, running_totals, whole_text

#: Bytes that a row has besides its text.
OVERHEAD = 16


def shard_plan(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; slots count a shard's rows from 0 without gaps."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = whole_text(docs, text_col)
    sized = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    placed = materialize(running_totals(ranged(sized, order, "shards"), order, start=F.col("size"), place=F.lit(1).cast("long")), "shard-line")
    total = placed.agg(F.sum("size").alias("total")).first()["total"] or 1
    placed = placed.withColumn("shard", F.expr(f"(start * 2 + size) * {int(shards)} div {2 * total}").cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    joined = placed.join(F.broadcast(firsts), "shard")  # one row for each shard
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of docs to path, one folder for each shard; docs needs an id of its own for each row."""
    plan = shard_plan(docs, shards, id_col, text_col).select(F.col("doc_id").alias("plan_id"), "shard", "slot")
    rows = docs.join(plan, docs[id_col].eqNullSafe(plan["plan_id"])).drop("plan_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
