"""Statistics of irrigation, fertigation and EC/pH reports, latest entries and carry-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import js, records

OPEN_START, OPEN_END = "1970-01-01", "2099-12-31"


def amount(text: Column) -> Column:
    """A lenient number of a report, blank as 0, a percent sign ignored; other text is null."""
    bare = F.replace(text.cast("string"), F.lit("%"), F.lit(""))
    return F.when(F.coalesce(F.trim(bare), F.lit("")) == "", F.lit(0.0)).otherwise(js.parse_float(bare))


def mean_with_blanks(values: Column) -> Column:
    """The mean over all rows, blank ones counting as 0, with two decimals."""
    return js.quantised(F.sum(values) / F.count(F.lit(1)), 2)


def irrigation_statistics(entries: DataFrame, by: list[str]) -> DataFrame:
    """Count, water and the means of a report for each group."""
    return entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"),
        js.quantised(F.sum(amount(F.col("total_water"))), 2).alias("water"),
        *[mean_with_blanks(amount(F.col(c))).alias(f"mean_{c}") for c in ("ec_in", "ec_out", "ph_in", "ph_out", "drain_percent")],
    )


def status_rules(statistics: DataFrame) -> DataFrame:
    """Adds statuses and recommendations, judged on the rounded means, and the drainage and retention shares."""
    drain, ec_in, ec_out, ph = (F.col(f"mean_{c}") for c in ("drain_percent", "ec_in", "ec_out", "ph_out"))
    return statistics.select(
        "*", records.drain_status(drain).alias("drain_status"), records.ec_status(ec_in, ec_out).alias("ec_status"), records.ph_status(ph).alias("ph_status"),
        records.recommendations(drain, ec_in, ec_out, ph).alias("advice"), (100 - drain).alias("retention"),
    )


def fertigation_statistics(entries: DataFrame, by: list[str] = ()) -> DataFrame:
    """Count, total and mean volume, irrigated hours and the dates of a report; bad numbers are 0."""
    volume = js.number_or_zero(F.col("total_volume"))
    hours = js.number_or_zero(F.col("duration_hours")) * js.number_or_zero(F.col("cycles"))
    return entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"), js.quantised(F.sum(volume), 2).alias("volume"), js.quantised(F.sum(volume) / F.count(F.lit(1)), 2).alias("mean_volume"),
        js.quantised(F.sum(hours), 2).alias("hours"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def print_statistics(entries: DataFrame, by: list[str] = ()) -> DataFrame:
    """Count, water and the first and last date of a printed report; dates that can't be read don't count, N/A where there are none."""
    date = F.col("date").try_cast("timestamp")
    shown = [F.coalesce(F.date_format(f(date), "yyyy-MM-dd"), F.lit("N/A")).alias(n) for f, n in ((F.min, "first_date"), (F.max, "last_date"))]
    water = F.coalesce(js.parse_float(F.col("total_water")), F.lit(0.0))
    return entries.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), js.fixed(js.quantised(F.sum(water), 2), 2).alias("water"), *shown)


def report_filter(entries: DataFrame, start: str | None = None, end: str | None = None, **equal: str) -> DataFrame:
    """Rows from start to the midnight of end (open where blank) whose columns equal what isn't blank; rows without a date are out."""
    at = F.col("date").cast("timestamp")
    kept = entries.filter((at >= F.lit(start or OPEN_START).cast("timestamp")) & (at <= F.lit(end or OPEN_END).cast("timestamp")))
    for name, value in equal.items():
        if value:
            kept = kept.filter(F.col(name) == value)
    return kept


def recent_filter(entries: DataFrame, period: str, ref_ts: Column, site: str = "") -> DataFrame:
    """Rows of today, the last 7 or 30 days before ref_ts, or all, of a site or all sites."""
    at = F.col("date").cast("timestamp")
    tests = {"all": F.lit(True), "today": F.to_date(at) == F.to_date(ref_ts), "7days": at >= ref_ts - F.expr("INTERVAL 7 DAYS"), "30days": at >= ref_ts - F.expr("INTERVAL 30 DAYS")}
    if period not in tests:
        raise ValueError(f"unknown period {period!r}")
    return entries.filter(tests[period] & (F.lit(site == "") | (F.col("site") == site)))


def options(entries: DataFrame, column: str) -> DataFrame:
    """The distinct values, in order, without blanks."""
    return entries.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(column).distinct().orderBy(column)


def first_seen(entries: DataFrame, column: str, seq: str) -> DataFrame:
    """The distinct values in the order of their first appearance."""
    return entries.groupBy(column).agg(F.min(seq).alias("first_seq")).orderBy("first_seq")


def last_points(entries: DataFrame, order: list[str], n: int = 30) -> DataFrame:
    """The n latest rows, oldest first."""
    return entries.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def latest_entry(entries: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of each group."""
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return entries.withColumn("newest", F.row_number().over(newest)).filter("newest = 1").drop("newest")


def previous_value(entries: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds `previous`: the value of the row before in its group, 0 where it is missing or there is none."""
    window = Window.partitionBy(*by).orderBy(*order)
    return entries.withColumn("previous", F.coalesce(F.lag(value).over(window), F.lit(0.0)))


def share(part: Column) -> Column:
    """Rows for which part holds, in whole percent; 0 without rows."""
    return F.coalesce(F.floor(100 * F.count_if(part) / F.nullif(F.count(F.lit(1)), F.lit(0)) + 0.5), F.lit(0)).cast("long")
