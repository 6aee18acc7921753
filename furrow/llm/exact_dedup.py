"""Exact deduplication by two passes and a Bloom filter.

Pass one counts 64-bit hashes of the texts and puts those that come more than once into a Bloom filter. Pass two tests
every row against it: only rows that pass go to the exact grouping by SHA-256, with their id and digest; all other rows go
straight to the result. Pass one moves eight bytes and a count for every distinct hash of a task; texts never move in mark_duplicates.

What is broadcast never exceeds max_filter_bits / 8 bytes (see bloom). Past that size more single rows are taken for possible repeats and shuffle (an id and a
32-byte digest each where only decisions are asked for); results don't change.

Defined results: a null text counts as empty; null ids rank below all others, and a group without any id keeps all
its rows' ids null and its rows; rows that share both text and id are one document, so keep_unique returns one of
them; an empty table gives an empty result; other columns are carried whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import bloom
from furrow.llm.common import carried, materialize, whole_text


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = bloom.MAX_FILTER_BITS) -> DataFrame:
    """Every row as `row`, with id, text_sha256, group_size, keep_id, ties and kept.

    Of equal texts the row with the largest id is kept; ties is the number of rows that share that id and text.
    """
    text = whole_text(docs, text_col)
    rows = carried(docs, id=docs[id_col], digest=F.xxhash64(text), text_sha256=F.sha2(text, 256))
    repeats, bits = bloom.repeated(rows.select("digest"), "digest", max_filter_bits)
    tested = bloom.probe(rows, "digest", repeats, bits)

    candidates = tested.filter("maybe").select("row", "id", "text_sha256")
    per_id = candidates.groupBy("text_sha256", "id").agg(F.count("*").alias("n"))
    groups = per_id.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), F.max(F.struct("id", "n")).alias("top"))
    groups = materialize(groups.select("text_sha256", "group_size", F.col("top.id").alias("keep_id"), F.col("top.n").alias("ties")), "dedup-groups")
    grouped = candidates.join(groups, "text_sha256").select("row", "id", "text_sha256", "group_size", "keep_id", "ties", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
    single = tested.filter(~F.col("maybe")).select("row", "id", "text_sha256", F.lit(1).cast("long").alias("group_size"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("ties"), F.lit(True).alias("kept"))
    return single.unionByName(grouped)


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns of docs.

    Which rows go is decided on ids and digests; texts move only for rows that share both with another, and for the few that the
    filter of those that go lets through by chance.
    """
    marked = mark_duplicates(docs, id_col, text_col).filter("group_size > 1").select("id", "text_sha256", "kept", "ties")
    marked = materialize(marked, "repeated-texts")
    rows = carried(docs, id=docs[id_col], text_sha256=F.sha2(whole_text(docs, text_col), 256))
    kept = bloom.without(rows, ["id", "text_sha256"], marked.filter(~F.col("kept")).select("id", "text_sha256").distinct())
    tied = materialize(marked.filter("kept AND ties > 1 AND id IS NOT NULL").select("id", "text_sha256").distinct(), "same-rows")
    if not tied.isEmpty():  # rows that share both text and id: one stays
        others = bloom.without(kept, ["id", "text_sha256"], tied)
        kept = others.unionByName(kept.join(tied, ["id", "text_sha256"], "left_semi").dropDuplicates(["id", "text_sha256"]).select(*others.columns))
    return kept.select("row.*")
