"""Streams are drained into tables, not into the driver."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from furrow.streaming import sensors


def _stream(spark, folder):
    return spark.readStream.schema("id long, ts timestamp").parquet(folder)


def test_drained_writes_tables(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.range(1000).withColumn("ts", F.timestamp_seconds("id")).write.parquet(folder)
    rows = sensors.drained(_stream(spark, folder), f"file://{tmp_path}/work")
    counts = sensors.drained(_stream(spark, folder).groupBy((F.col("id") % 3).alias("k")).count(), f"file://{tmp_path}/work", "complete")
    assert sorted(r.id for r in rows.collect()) == list(range(1000))
    assert {r.k: r["count"] for r in counts.collect()} == {0: 334, 1: 333, 2: 333}
    assert all(len(df.inputFiles()) > 0 and all(f"{tmp_path}/work" in f for f in df.inputFiles()) for df in (rows, counts))


def test_drained_without_input(spark, tmp_path):
    spark.createDataFrame([], "id long, ts timestamp").write.parquet(f"{tmp_path}/in")
    assert sensors.drained(_stream(spark, f"{tmp_path}/in").filter("id < 0"), f"file://{tmp_path}/work").count() == 0


def test_rows_that_are_too_late_are_left_out(spark, tmp_path):
    """Nine days late under a bound of an hour, and half an hour late under it."""
    schema = "event_id long, ts timestamp, value double, event_type string"
    day = datetime(2024, 3, 10)
    # Spark tests for lateness by the watermark of the batch before the last, so one lies between.
    batches = [[(1, day, 1.0, "a"), (2, day + timedelta(hours=30), 2.0, "a")], [(5, day + timedelta(hours=30), 3.0, "a")], [(3, day - timedelta(days=9), 100.0, "a"), (4, day + timedelta(hours=29, minutes=30), 4.0, "a")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for path in (tmp_path / "in").glob("*.parquet"):
            if path.stat().st_mtime > 1_000_000:
                os.utime(path, (1000 + k, 1000 + k))  # files are taken by their age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = sensors.tumbling(stream, "1 day", "1 hour", "event_type")
    work = f"{tmp_path}/work"
    query = found.writeStream.outputMode("append").format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([(None, datetime(2030, 1, 1), None, None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = found.writeStream.outputMode("append").format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{work}/out").orderBy("start").collect()
    assert [(r.start, r.events, r.mean) for r in rows] == [(day, 1, 1.0), (day + timedelta(days=1), 3, 3.0)]
