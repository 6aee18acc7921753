"""Spark sessions with the settings the library's semantics rest on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: UTC makes date text independent of the host; LAST_WIN gives maps shallow-merge semantics.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int | None = None, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("furrow")
    settings = SEMANTICS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share, from spark.checkpoint.dir; a local one only where the session is local and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "local").startswith("local"):
        raise RuntimeError("a cluster's session must set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/furrow-work"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df from a new table in the shared folder, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.paths.append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if scope is not None:
        scope.tables.append((table, path))
    return table


class Scope:
    """The working tables written within working_tables()."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.tables: list[tuple[DataFrame, str]] = []
        self.kept: set[str] = set()

    def keep(self, table: DataFrame) -> DataFrame:
        """A table that outlives the scope, as what is returned reads it."""
        self.kept |= {path for own, path in self.tables if own is table}
        return table


_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[Scope]:
    """Deletes the tables that stored() writes within it, but for those kept; these belong to the scope around it, if there is one."""
    outer, scope = _SCOPE.get(), Scope()
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        if outer is not None:
            outer.paths += [p for p in scope.paths if p in scope.kept]
            outer.tables += [(t, p) for t, p in scope.tables if p in scope.kept]
        for path in scope.paths:
            if path not in scope.kept:
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder by Spark's own file systems."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
