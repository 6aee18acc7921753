"""Byte ranges of files for tasks, read by Arrow's file systems."""

from __future__ import annotations

import os

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the place in it of a path as Spark writes it."""
    path = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


#: A task takes so many ranges, or bytes of them, where there are more than FEW tasks' worth: small files and ranges don't get a task each.
RANGES_OF_TASK, BYTES_OF_TASK, FEW = 256, 32 << 20, 64


def byte_ranges(spark: SparkSession, path: str, size: int) -> tuple[DataFrame, int]:
    """path, length, start and until of ranges of about `size` bytes that cover the files, dealt over tasks, and how many tasks; an empty file has none."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size) * size, F.lit(size).cast("long"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.select("path", "length", "start", F.least(F.col("start") + size, F.col("length")).alias("until"))
    n, length = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("until") - F.col("start")), F.lit(0))).first()
    tasks = max(1, min(n, max(FEW, -(-n // RANGES_OF_TASK), -(-length // BYTES_OF_TASK))))
    return ranges.repartition(tasks, "path", "start"), tasks
