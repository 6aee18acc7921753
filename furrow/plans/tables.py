"""The test tables in the library's terms: see FIXTURES.md for what stands for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Band columns by the line items' columns that stand for them.
BANDS = {"B02": "l_linenumber", "B03": "l_partkey", "B04": "l_quantity", "B08": "l_extendedprice", "B11": "l_suppkey", "B12": "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pixel and scene time, with bands, scene class, quality bits, place and cloud cover."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_shipdate").alias("time"), F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"),
        *[F.col(c).cast("double").alias(b) for b, c in BANDS.items()],
        F.col("l_linenumber").alias("SCL"), F.col("l_orderkey").alias("QA60"), (F.col("l_discount") * 100).alias("cloud_cover"),
    )


#: The same as SQL.
PIXELS_SQL = "pixels AS (SELECT l_shipdate AS time, l_partkey::DOUBLE AS x, l_suppkey::DOUBLE AS y, " + ", ".join(f"{c}::DOUBLE AS {b}" for b, c in BANDS.items()) + ", l_linenumber AS SCL, l_orderkey AS QA60, l_discount * 100 AS cloud_cover FROM lineitem)"


def irrigation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report entries as texts, some of them blank: a site is a ship's return flag and line status."""
    items = table(spark, sf_dir, "lineitem")
    text = {"total_water": "l_quantity", "ec_in": "l_discount", "ec_out": "l_tax", "ph_in": "l_linenumber", "ph_out": "l_linenumber"}
    return items.select(
        F.col("l_shipdate").alias("date"), "l_orderkey", F.col("l_returnflag").alias("site"), F.col("l_linestatus").alias("project"),
        *[F.when(F.col("l_linenumber") != 7, F.format_string("%.2f", F.abs(F.col(c).cast("double")))).otherwise("").alias(n) for n, c in text.items()],
        F.concat(F.format_string("%d", F.col("l_suppkey") % 45), F.lit("%")).alias("drain_percent"),
    )


IRRIGATION_SQL = """entries AS (
    SELECT l_shipdate AS date, l_orderkey, l_returnflag AS site, l_linestatus AS project,
           CASE WHEN l_linenumber <> 7 THEN round(abs(l_quantity), 2) ELSE 0 END AS total_water,
           CASE WHEN l_linenumber <> 7 THEN round(abs(l_discount), 2) ELSE 0 END AS ec_in,
           CASE WHEN l_linenumber <> 7 THEN round(abs(l_tax), 2) ELSE 0 END AS ec_out,
           CASE WHEN l_linenumber <> 7 THEN l_linenumber::DOUBLE ELSE 0 END AS ph_in,
           CASE WHEN l_linenumber <> 7 THEN l_linenumber::DOUBLE ELSE 0 END AS ph_out,
           (l_suppkey % 45)::DOUBLE AS drain_percent
    FROM lineitem)"""
