"""Queries over texts: keys, languages, topics, secrets and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions import js, text
from furrow.plans.tables import table


def key_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("​  "), F.upper("p_name"), F.lit(" ﻿"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normal_key(raw, compatibility=False).alias("key"))


def key_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("ＡＢ "), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.normal_key(raw).alias("key"))


def token_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.token(F.col("p_brand")).alias("token"), text.collapsed(F.concat(F.lit("  "), F.replace("p_type", F.lit(" "), F.lit("   ")))).alias("name"), text.file_name(F.col("p_brand")).alias("file_name"))


def lang_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" مرحبا"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.language(said).alias("language"))


_WORDS = ["", " water the fields", " my tomatoes have a worm", " what about dates and npk", " hello"]


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("conv_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), extra).alias("text"))


def topic_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of each user's message, or for a follow-up that of the newest of the last three messages that has one."""
    said = _messages(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn", text.topic(F.col("text")).alias("own"), text.intent(F.col("text")).alias("intent"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return said.select("conv_id", "turn", "intent", F.coalesce("own", F.when(F.col("intent") == "follow_up", F.last("own", ignorenulls=True).over(before))).alias("topic"))


def last_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.concat(F.lit('{"user":{"apiKey":"k'), F.col("event_id").cast("string"), F.lit('","list":[{"password":1}]},"inner":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", text.mask_json(props).alias("masked"))


def json_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


def cookie_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("id="), F.col("user_id").cast("string"), F.lit("; kind="), F.col("event_type"), F.lit(";junk"))
    found = table(spark, sf_dir, "events").select("event_id", text.cookies(header).alias("cookies"))
    return found.select("event_id", F.try_element_at("cookies", F.lit("id")).alias("id"), F.try_element_at("cookies", F.lit("kind")).alias("kind"))


def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("p_size").cast("string"), F.lit(".5 mm"))
    return table(spark, sf_dir, "part").select("p_partkey", js.parse_float(raw).alias("as_float"), js.parse_int(raw).alias("as_int"), js.number_or_zero(raw).alias("strict"))


def epoch_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.ymd(F.col("event_id") * 86_400_000).alias("date"))


def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.password_hash(F.col("c_name")).alias("hash"))


def signed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = text.signature("key", F.col("props"))
    signature = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x"), good)).otherwise("none")
    checked = table(spark, sf_dir, "events").select("event_type", text.signature_holds("key")(F.col("props"), signature).alias("holds"))
    return checked.groupBy("event_type").agg(F.count_if("holds").alias("verified"), F.count(F.lit(1)).alias("events"))


QUERIES = {f.__name__: f for f in (key_normalize, key_compatibility, token_normalize, lang_choice, topic_detect, last_user_message, mask_secrets, json_property, cookie_parse, lenient_numbers, epoch_dates, record_hash, signed_events)}
_TOPIC = " ".join(f"WHEN regexp_matches(t, '{'|'.join(words)}') THEN '{name}'" for name, words in text.TOPICS.items())
ORACLES = {
    "key_normalize": "SELECT p_partkey, lower(trim(p_name)) AS key FROM part",
    "key_compatibility": "SELECT n_nationkey, 'ab ' || lower(n_name) AS key FROM nation",
    "token_normalize": "SELECT p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS token, trim(regexp_replace(p_type, ' +', ' ', 'g')) AS name, substr(regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) AS file_name FROM part",
    "lang_choice": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR contains(lower(text), 'arabic') THEN 'ar' ELSE 'en' END AS language FROM conversations",
    "topic_detect": f"""WITH m AS (
            SELECT conv_id, turn, lower(coalesce(text, '') || ['', ' water the fields', ' my tomatoes have a worm', ' what about dates and npk', ' hello'][(conv_id % 5 + 1)::INT]) AS t FROM conversations WHERE role = 'user'),
        o AS (SELECT *, CASE {_TOPIC} END AS own,
            CASE WHEN regexp_matches(t, '^(hi|hello|hey|greetings)') THEN 'greeting' WHEN regexp_matches(t, 'who are you|your name') THEN 'identity' WHEN regexp_matches(t, 'help|what can you do') THEN 'help'
                WHEN regexp_matches(t, '^(more|detail|continue|what else|again|info)') OR len(string_split(t, ' ')) <= 3 THEN 'follow_up' ELSE 'question' END AS intent FROM m)
        SELECT conv_id, turn, intent, coalesce(own, CASE WHEN intent = 'follow_up' THEN last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END) AS topic FROM o""",
    "last_user_message": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1",
    "mask_secrets": """SELECT event_id, '{"user": {"apiKey": "***", "list": [{"password": "***"}]}, "inner": ' || coalesce(props, 'null') || '}' AS masked FROM events""",
    "json_property": "SELECT event_id, TRY_CAST(props->>'$.k' AS INT) AS k FROM events",
    "cookie_parse": "SELECT event_id, user_id::VARCHAR AS id, event_type AS kind FROM events",
    "lenient_numbers": "SELECT p_partkey, p_size + 0.5::DOUBLE AS as_float, p_size::BIGINT AS as_int, 0.0::DOUBLE AS strict FROM part",
    "epoch_dates": "SELECT event_id, strftime(DATE '1970-01-01' + event_id::INT, '%Y-%m-%d') AS date FROM events",
    "record_hash": "SELECT c_custkey, sha256(c_name) AS hash FROM customer",
    "signed_events": "SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS verified, count(*) AS events FROM events GROUP BY 1",
}
