"""A sensor stream, topics, ring buffers and windows over events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow.functions import text

SENSOR_PERIOD_MS = 3000
#: Each sensor topic's lowest and highest reading.
SENSORS = {"sensor/ec": (1.0, 3.0), "sensor/ph": (6.0, 8.0)}
EVENT_RING, TOPIC_RING = 200, 50


def sensor_stream(spark: SparkSession, seed: int = 0, rows_per_batch: int = 1) -> DataFrame:
    """topic, payload (text with two decimals) and ts: one reading of each sensor for each tick."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("advanceMillisPerBatch", SENSOR_PERIOD_MS).load()
    # Readings come from a hash of the tick, so that a batch run again gives the same ones.
    draw = lambda topic: F.pmod(F.xxhash64("value", F.lit(topic), F.lit(seed)), F.lit(1_000_000)) / 1e6
    readings = [F.struct(F.lit(t).alias("topic"), F.format_string("%.2f", F.lit(low) + draw(t) * (high - low)).alias("payload")) for t, (low, high) in SENSORS.items()]
    return ticks.select(F.col("timestamp").alias("ts"), F.inline(F.array(*readings))).select("topic", "payload", "ts")


def parsed(frames: DataFrame, schema: StructType | str, column: str = "payload") -> DataFrame:
    """Frames as columns by JSON; those that aren't JSON of an object are left out."""
    value = F.from_json(column, schema)
    return frames.filter(F.try_parse_json(column).isNotNull()).withColumn("message", value).filter("message IS NOT NULL").select(*[c for c in frames.columns if c != column], "message.*")


def verified(requests: DataFrame, secret: str) -> DataFrame:
    """Requests (body, signature) whose signature holds; of a stream or a table."""
    return requests.filter(text.signature_holds(secret)(F.col("body"), F.col("signature")))


def by_topic(messages: DataFrame, topic: str) -> DataFrame:
    return messages.filter(F.col("topic") == topic)


def tumbling(events: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """Counts and means of `value` for each window of ts; rows later than `late` are left out."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width), *by)
    return found.agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "events", "mean")


def sliding(events: DataFrame, width: str, step: str, late: str, *by: str) -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), *by)
    return found.agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), *by, "events")


def sessions(events: DataFrame, gap: str, late: str, *by: str) -> DataFrame:
    """Counts of each run of events no further apart than gap."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), *by)
    return found.agg(F.count(F.lit(1)).alias("events")).select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *by, "events")


def without_repeats(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first event of each key within `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def with_end(events: DataFrame, folder: str, end: str = "9999-01-01") -> DataFrame:
    """The stream and, from a file of its own in folder, a last event whose time closes all windows before it; its other columns are null.

    In append mode a window comes out once, when the watermark has passed it, so rows that are too late are left out and state shrinks.
    """
    spark = events.sparkSession
    last = spark.range(1).select(*[F.lit(end).cast("timestamp").alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    last.write.parquet(folder)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder))


def ring_writer(path: str, size: int, order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the newest rows in a versioned table; latest_ring reads the newest version.

    A batch that runs again replaces its own version, so the result is the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        older = latest_ring(spark, path, before=batch_id)
        rows = batch if older is None else older.unionByName(batch)
        rows.orderBy(*[F.col(c).desc() for c in order]).limit(size).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def latest_ring(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of the newest version (below `before`), or None."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    versions = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(root) if s.getPath().getName().startswith("version=")]
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{path}/version={max(versions)}") if versions else None


def drained(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream with an end gives, as a table in a new folder under `checkpoint`: executors write it, and nothing passes through the driver.

    In append mode by the Parquet file sink; in complete mode every batch writes its whole outcome as a version, and the newest counts.
    """
    spark, work = stream.sparkSession, f"{checkpoint}/drained-{uuid.uuid4().hex}"
    out = f"{work}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        root = spark._jvm.org.apache.hadoop.fs.Path(out)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)  # a stream without a batch leaves an empty table
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    writer.foreachBatch(write).start().awaitTermination()
    newest = latest_ring(spark, out)
    return spark.createDataFrame([], stream.schema) if newest is None else newest
