"""Queries that run a stream over the events to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import js, text
from furrow.session import shared_folder
from furrow.streaming import sensors


def _work(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; ts gets a time zone, which watermarks need."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    files = spark.readStream.schema(schema)
    stream = files.parquet(path) if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory() else files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark)
    done = sensors.drained(sensors.tumbling(sensors.with_end(_events(spark, sf_dir), f"{work}/end"), "1 day", "1 hour", "event_type"), work)
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", js.quantised(F.col("mean")).alias("mean"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark)
    done = sensors.drained(sensors.sliding(sensors.with_end(_events(spark, sf_dir), f"{work}/end"), "2 days", "1 day", "1 hour"), work)
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "events")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark)
    done = sensors.drained(sensors.sessions(sensors.with_end(_events(spark, sf_dir), f"{work}/end"), "30 minutes", "1 hour", "user_id"), work)
    return done.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "events")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event comes twice, and every seventh again under a time of its own."""
    times = F.when(F.col("event_id") % 21 == 0, F.array(F.lit(0), F.lit(0), F.lit(7))).when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(0))).when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))
    repeated = _events(spark, sf_dir).withColumn("later", F.explode(times)).withColumn("ts", F.col("ts") + F.make_dt_interval(mins=F.col("later"))).drop("later")
    return sensors.drained(sensors.without_repeats(repeated, "event_id", "10 days"), _work(spark)).select("event_id", "event_type")


def stream_event_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark)
    writer = sensors.ring_writer(f"{work}/ring", sensors.EVENT_RING, ["ts", "event_id"])
    query = _events(spark, sf_dir).writeStream.foreachBatch(writer).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sensors.latest_ring(spark, f"{work}/ring").select("event_id", "event_type")


def stream_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _events(spark, sf_dir).withColumnsRenamed({"event_type": "topic", "props": "payload"})
    return sensors.drained(sensors.parsed(sensors.by_topic(messages, "purchase"), "k int"), _work(spark)).select("event_id", "k")


def stream_sensor_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each topic in the first batch of the sensor stream, ten ticks, and how many lie in the sensor's range."""
    found = sensors.drained(sensors.sensor_stream(spark, rows_per_batch=10), _work(spark))
    value = F.col("payload").cast("double")
    inside = F.lit(False)
    for topic, (low, high) in sensors.SENSORS.items():
        inside = inside | ((F.col("topic") == topic) & value.between(low, high))
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("readings"), F.count_if(inside).alias("inside"), F.count_if(F.col("payload").rlike(r"^\d\.\d\d$")).alias("two_decimals"))


def stream_topic_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 messages of one topic."""
    work = _work(spark)
    messages = sensors.by_topic(_events(spark, sf_dir).withColumnRenamed("event_type", "topic"), "purchase")
    writer = sensors.ring_writer(f"{work}/ring", sensors.TOPIC_RING, ["ts", "event_id"])
    messages.writeStream.foreachBatch(writer).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sensors.latest_ring(spark, f"{work}/ring").select("event_id", "topic")


def stream_webhook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed bodies as a stream, of which those with a good signature go on: here the events of even ids are signed with the right secret."""
    signed = _events(spark, sf_dir).select("event_id", F.coalesce("props", F.lit("")).alias("body"))
    signed = signed.withColumn("signature", F.when(F.col("event_id") % 2 == 0, text.signature("secret", F.col("body"))).otherwise(text.signature("other", F.col("body"))))
    return sensors.drained(sensors.verified(signed, "secret"), _work(spark)).select("event_id", "body")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_dedup, stream_event_ring, stream_topic, stream_sensor_topics, stream_topic_ring, stream_webhook)}
ORACLES = {
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean FROM events GROUP BY ALL",
    "stream_sliding": "SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS events FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1",
    "stream_session": """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS events FROM s GROUP BY user_id, session""",
    "stream_dedup": "SELECT event_id, event_type FROM events",
    "stream_event_ring": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "stream_topic": "SELECT event_id, TRY_CAST(props->>'$.k' AS INT) AS k FROM events WHERE event_type = 'purchase'",
    "stream_sensor_topics": "SELECT unnest(['sensor/ec', 'sensor/ph']) AS topic, 10::BIGINT AS readings, 10::BIGINT AS inside, 10::BIGINT AS two_decimals",
    "stream_topic_ring": "SELECT event_id, event_type AS topic FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "stream_webhook": "SELECT event_id, coalesce(props, '') AS body FROM events WHERE event_id % 2 = 0",
}
