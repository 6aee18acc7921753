"""Exact quantiles without one task that holds all values.

Equal values are counted first; the counts are put in order over range partitions, whose totals give every value's place
among all rows. A quantile needs the values at two places at most, and only these are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import stored


def exact_quantiles(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row: `quantiles`, an array with the value at each share of the rows, between values by linear interpolation; nulls where there are no values.

    Nulls aren't counted.
    """
    counted = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    dealt = stored(counted.repartitionByRange("value").withColumn("slice", F.spark_partition_id()), "quantile-values")
    per_slice = dealt.groupBy("slice").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("slice", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(offsets), "slice")  # one row for each slice
    placed = placed.select("value", (F.col("before") + F.col("offset")).alias("first"), (F.col("before") + F.col("offset") + F.col("n")).alias("end"))

    total = dealt.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    asked = total.select(F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("number", "share"), "rows")
    asked = asked.select("number", (F.col("share") * (F.col("rows") - 1)).alias("at")).withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    wide = F.broadcast(asked)  # a row for each share
    hits = placed.join(wide, (F.col("low").between(F.col("first"), F.col("end") - 1)) | (F.col("high").between(F.col("first"), F.col("end") - 1)))
    low = F.max(F.when(F.col("low").between(F.col("first"), F.col("end") - 1), F.col("value")))
    high = F.max(F.when(F.col("high").between(F.col("first"), F.col("end") - 1), F.col("value")))
    found = hits.groupBy("number", "at", F.col("low").alias("low_at")).agg(low.alias("a"), high.alias("b"))
    found = found.select("number", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("low_at"))).alias("q"))
    numbers = asked.select("number").join(F.broadcast(found), "number", "left")
    return numbers.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "q"))), lambda x: x["q"]).alias("quantiles"))
