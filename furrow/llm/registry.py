"""The operators' queries over the documents table, and their SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import alignment, conversations, exact_dedup, fingerprints, mixing, packing, pii, quality, quality_rules, sharding, simhash, token_counts, token_store
from furrow.llm.common import documents
from furrow.session import shared_folder

SHARDS = 40
MIX_WEIGHTS = [5, 2, 1]
#: A deployment passes its own secret; this one keeps the query's results the same from run to run.
PSEUDONYM_KEY = "example key"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_duplicates(documents(spark, sf_dir))
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard_plan(documents(spark, sf_dir), SHARDS)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_digests(spark, path)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(documents(spark, sf_dir), PSEUDONYM_KEY)
    counts = [F.size(F.filter("kinds", _is(kind))).alias(f"n_{kind}") for kind in pii.KINDS]
    return done.select("row.doc_id", "text", *counts)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda found: found == kind


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir), MIX_WEIGHTS)
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs, quality.fit(docs, labels))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = packing.Capacity(tokens=2048)
    return packing.pack(packing.pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 0, capacity.tokens), capacity)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edits(documents(spark, sf_dir))
    prints = [fingerprints.as_text(F.col(a)).alias(b) for a, b in (("samples", "fingerprint"), ("edited_samples", "edited_fingerprint"))]
    return found.select(F.col("id").alias("doc_id"), F.col("n_chars").cast("long"), "edited_sha256", *prints, "near_edited", "near_next")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_all(conversations.damage(rows), rows)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_sharding, op3_token_store, op4_pii, op5_simhash, op6_mixing, op7_quality, op8_token_counts, op9_packing, op10_fingerprints, op11_quality_rules, op12_conversations, op13_alignment)}

ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_mixing": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
        w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM r),
        f AS (
            SELECT *, row_number() OVER filling AS cap_rank,
                   (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER before, 0) AS left_words,
                   (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0) AS left_weight
            FROM w WINDOW filling AS (ORDER BY cap::DOUBLE / weight, rank),
                          before AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min(left_words::DOUBLE / left_weight::DOUBLE, cap_rank) AS level FROM f
              WHERE left_words::DOUBLE / left_weight::DOUBLE <= cap::DOUBLE / weight),
        t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM f, l),
        c AS (
            SELECT d.doc_id, d.size, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS rate,
                   ('0x' || substr(sha256('17:' || d.doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM c""",
    "op12_conversations": r"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS key FROM conversations),
        hashed AS (
            SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(key, lambda crc, c: list_reduce(
                [1, 2, 3, 4, 5, 6, 7, 8], lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, c)), 4294967295)) % 20 AS kind FROM keyed),
        damaged AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hashed, (VALUES (1), (2)) AS times (copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
        marked AS (
            SELECT *, row_number() OVER own AS k, left(role, 1) AS initial, lag(left(role, 1)) OVER own || left(role, 1) AS pair,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                        WHEN nth > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
            FROM numbered WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)),
        grammar (state, initial, role, next) AS (
            VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
        inserts AS (
            SELECT state, '' AS audit, []::VARCHAR[] AS lines, state AS reached, 0 AS cost FROM generate_series(0, 3) AS s (state)
            UNION ALL
            SELECT i.state, i.audit || 'I', list_append(i.lines, g.role || ':'), g.next, i.cost + 5
            FROM inserts AS i JOIN grammar AS g ON g.state = i.reached AND g.role IS NOT NULL WHERE length(i.audit) < 2),
        edits AS (
            SELECT i.state, i.audit || 'K' AS audit, i.lines, 'K' AS edit, g.initial, NULL AS role, g.next, i.cost FROM inserts AS i JOIN grammar AS g ON g.state = i.reached
            UNION ALL
            SELECT i.state, i.audit || 'R', i.lines, 'R', NULL, g.role, g.next, i.cost + 1 FROM inserts AS i JOIN grammar AS g ON g.state = i.reached AND g.role IS NOT NULL
            UNION ALL
            SELECT state, audit || 'D', lines, 'D', NULL, NULL, reached, cost + 2 FROM inserts),
        paths AS (
            SELECT conv_id, 0 AS k, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM (SELECT DISTINCT conv_id FROM marked)
            UNION ALL
            SELECT p.conv_id, m.k, e.next, min({
                'cost': p.best.cost + e.cost + CASE WHEN m.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END, 'audit': p.best.audit || e.audit,
                'lines': list_concat(list_concat(p.best.lines, e.lines), CASE e.edit WHEN 'D' THEN [] ELSE [coalesce(e.role, m.role) || ':' || m.text] END)})
            FROM paths AS p JOIN marked AS m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.k = p.k + 1 JOIN edits AS e ON e.state = p.state
            WHERE e.edit = 'D' OR (m.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.initial = m.initial))
            GROUP BY p.conv_id, m.k, e.next),
        counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM marked GROUP BY conv_id),
        done AS (
            SELECT p.conv_id, min({'cost': p.best.cost + i.cost, 'audit': p.best.audit || i.audit, 'lines': list_concat(p.best.lines, i.lines)}) AS best
            FROM paths AS p JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.k JOIN inserts AS i ON i.state = p.state AND i.reached IN (0, 3) GROUP BY p.conv_id)
        SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
               coalesce(c.illegal, 0) AS illegal, coalesce(d.best.cost, 0)::BIGINT AS cost, coalesce(d.best.audit, '') AS audit,
               sha256(coalesce(array_to_string(d.best.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
             LEFT JOIN done AS d ON d.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
