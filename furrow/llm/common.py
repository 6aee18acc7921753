"""What the operators share: working tables, row carriers and ordered prefix sums."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.session import stored

#: The columns of the documents table, which every stage of a pipeline keeps.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back, which cuts its lineage."""
    return stored(df, label)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1400) -> Iterator[None]:
    """Within it, an action passes at most so many rows at a time to Python workers: whole texts are large, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def carried(df: DataFrame, **columns: Column) -> DataFrame:
    """The named columns beside the whole row as `row`, so that no name of df can clash."""
    return df.select(F.struct(*[df[f"`{name}`"] for name in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text as it is, null as empty."""
    return F.coalesce(df[column], F.lit(""))


def n_slices(df: DataFrame) -> int:
    """Partitions for range partitioning: as many as the session's shuffles have."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df in `order` over range partitions, numbered by `slice`, as a working table.

    Range partitions are cut on all the columns of the order, so one frequent value doesn't fill one of them
    as long as a later column tells its rows apart.
    """
    dealt = df.repartitionByRange(n_slices(df), *[F.col(c).asc_nulls_first() for c in order])
    return materialize(dealt.withColumn("slice", F.spark_partition_id()), label)


def running_totals(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """Adds, for each name=column, the sum over all rows before this one, in the global order.

    df is the outcome of ranged(). Only one total for each slice meets in one task; rows stay in their slices.
    """
    per_slice = df.groupBy("slice").agg(*[F.sum(c).alias(f"{n}_slice") for n, c in sums.items()])
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("slice", *[F.coalesce(F.sum(f"{n}_slice").over(earlier), F.lit(0)).alias(f"{n}_offset") for n in sums])
    before = Window.partitionBy("slice").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    within = df.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{n}_within") for n, c in sums.items()])
    joined = within.join(F.broadcast(offsets), "slice")  # one row for each slice
    return joined.select(*df.columns, *[(F.col(f"{n}_within") + F.col(f"{n}_offset")).alias(n) for n in sums])
