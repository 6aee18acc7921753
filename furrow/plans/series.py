"""Queries over pixels, and over irrigation and EC/pH records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import indices, js, records
from furrow.operators import raster, reports
from furrow.plans.tables import BANDS, IRRIGATION_SQL, PIXELS_SQL, irrigation_entries, pixels, table

CLEAR = "SCL IN (2, 4, 5, 6, 7)"
SQL_INDEX = {
    "NDVI": "(B08 - B04) / nullif(B08 + B04, 0)",
    "NDWI": "(B03 - B08) / nullif(B03 + B08, 0)",
    "NDMI": "(B08 - B11) / nullif(B08 + B11, 0)",
    "SAVI": "(B08 - B04) / nullif(B08 + B04 + 0.5::DOUBLE, 0) * 1.5::DOUBLE",
    "BSI": "((B11 + B04) - (B08 + B02)) / nullif((B11 + B04) + (B08 + B02), 0)",
    "EVI": "2.5::DOUBLE * ((B08 - B04) / nullif(B08 + 6 * B04 - 7.5::DOUBLE * B02 + 1, 0))",
    "EVI2": "2.5::DOUBLE * ((B08 - B04) / nullif(B08 + 2.4::DOUBLE * B04 + 1, 0))",
    "NBR": "(B08 - B12) / nullif(B08 + B12, 0)",
}


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mask(pixels(spark, sf_dir), indices.clear_class(F.col("SCL")), list(BANDS))


def _day(series: DataFrame) -> DataFrame:
    return series.select("index", F.date_format("time", "yyyy-MM-dd").alias("date"), js.quantised(F.col("value")).alias("value"))


def _series(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _day(raster.time_series(_masked(spark, sf_dir), [name])).select("date", "value").orderBy("date")

    return query


def _series_sql(name: str) -> str:
    return f"WITH {PIXELS_SQL} SELECT strftime(time, '%Y-%m-%d') AS date, floor(avg({SQL_INDEX[name]}) * 1e6 + 0.5) / 1e6 AS value FROM pixels WHERE {CLEAR} GROUP BY time"


def ts_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(raster.time_series(_masked(spark, sf_dir), list(SQL_INDEX)))


def ts_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(SQL_INDEX)
    found = raster.series_statistics(raster.time_series(_masked(spark, sf_dir), names), names)
    return found.select("index", *[js.quantised(F.col(c)).alias(c) for c in ("mean", "median", "min", "max")], "count")


_ALL_SERIES = " UNION ALL ".join(f"SELECT '{n}' AS index, time, avg({e}) AS value FROM pixels WHERE {CLEAR} GROUP BY time" for n, e in SQL_INDEX.items())


def composite_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = raster.median_composite(_masked(spark, sf_dir), ["B04", "B08"]).filter("B04 IS NOT NULL")
    return made.select("x", "y", *[js.quantised(F.col(b)).alias(b) for b in ("B04", "B08")])


def qa_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    clear = pixels(spark, sf_dir).filter(indices.clear_bits(F.col("QA60")))
    return clear.groupBy("SCL").agg(F.count(F.lit(1)).alias("pixels"), js.quantised(F.avg(indices.ndvi(indices.bands(indices.REFLECTANCE_SCALE)))).alias("mean_ndvi"))


def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.clip(pixels(spark, sf_dir), (100, 10, 900, 60))
    return found.groupBy("y").agg(F.count(F.lit(1)).alias("pixels"), F.min("x").alias("west"), F.max("x").alias("east"))


def region_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.region_mean(raster.clip(_masked(spark, sf_dir), (100, 10, 900, 60)), indices.ndvi(indices.bands()))


def scene_search_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = pixels(spark, sf_dir).groupBy("time").agg(F.min("cloud_cover").alias("cloud_cover"), F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"))
    scenes = scenes.select(F.date_format("time", "yyyyMMdd").alias("scene_id"), F.col("time").alias("datetime"), "cloud_cover", "west", "south", "east", "north")
    found = raster.search_scenes(scenes, "1995-01-01", "1996-12-31 23:59:59", 1.0, (1, 1, 1e9, 1e9), limit=20)
    return found.select("scene_id", F.date_format("datetime", "yyyy-MM-dd").alias("date"), js.quantised(F.col("cloud_cover"), 2).alias("cloud_cover"), "west", "south", "east", "north")


def band_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = raster.indices_by_expression(_masked(spark, sf_dir), {"ndvi": "(B08 - B04) / (B08 + B04)", "evi2": "2.5D * (B08 - B04) / (B08 + 2.4D * B04 + 1)"})
    return made.groupBy("SCL").agg(*[js.quantised(F.avg(c)).alias(c) for c in ("ndvi", "evi2")]).filter("ndvi IS NOT NULL")


def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("scenes"))
    spine = raster.date_spine(spark, "1997-06-30")
    return F.broadcast(spine).join(items, "date", "left").select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce("scenes", F.lit(0)).alias("scenes"))


def report_irrigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.irrigation_statistics(irrigation_entries(spark, sf_dir), ["site", "project"])


MEANS = ("ec_in", "ec_out", "ph_in", "ph_out", "drain_percent")
_STATS_SQL = f"WITH {IRRIGATION_SQL}, stats AS (SELECT site, project, count(*) AS entries, floor(sum(total_water) * 100 + 0.5) / 100 AS water, " + ", ".join(f"floor(sum({c}) / count(*) * 100 + 0.5) / 100 AS mean_{c}" for c in MEANS) + " FROM entries GROUP BY ALL)"


def report_status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.status_rules(report_irrigation(spark, sf_dir))
    return found.select("site", "project", "drain_status", "ec_status", "ph_status", F.size("advice").cast("long").alias("advised"), js.quantised(F.col("retention"), 2).alias("retention"))


def report_fertigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    entries = items.select(
        F.col("l_returnflag").alias("site"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("total_volume"),
        F.col("l_linenumber").cast("string").alias("duration_hours"), (F.col("l_suppkey") % 4).cast("string").alias("cycles"),
    )
    return reports.fertigation_statistics(entries, ["site"])


def report_filtered_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = reports.report_filter(irrigation_entries(spark, sf_dir), "1995-03-01", "1995-03-31", site="A", project="")
    return kept.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("entries"))


def report_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = reports.recent_filter(irrigation_entries(spark, sf_dir).filter("date <= TIMESTAMP_NTZ '1996-05-15 12:00:00'"), "7days", F.lit("1996-05-15 12:00:00").cast("timestamp"))
    return kept.groupBy("site").agg(F.count(F.lit(1)).alias("entries"))


def distinct_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.options(table(spark, sf_dir, "part"), "p_brand")


def first_seen_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


def last30_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_points(table(spark, sf_dir, "events").select("ts", "event_id", js.quantised(F.col("value"), 4).alias("value")), ["ts", "event_id"])


def _ec_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.floor(F.abs("value"))).cast("double").alias("drip"))
    return reports.previous_value(events, "drip", ["user_id"], ["ts", "event_id"])


_EC_SQL = """WITH e AS (
    SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN floor(abs(value)) END::DOUBLE AS drip FROM events),
r AS (SELECT *, coalesce(lag(drip) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS previous FROM e)"""


def prev_drip_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ec_records(spark, sf_dir).select("event_id", "drip", "previous")


def ec_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _ec_records(spark, sf_dir)
    n = records.n_drip(F.coalesce("drip", F.lit(0.0)))
    return entries.select(
        "event_id", n.alias("n_drip"), records.drain_percent(F.col("event_id") % 50 * 1.0, n).alias("drain_percent"),
        records.total_water(F.lit(1.5), F.col("user_id") % 7 + F.lit(0.9)).alias("total_water"),
        records.calculated_water(F.coalesce("drip", F.lit(0.0)), F.col("previous")).alias("calculated_water"),
    )


def latest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_entry(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "user_id")


def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "error", "x1").otherwise(F.col("user_id").cast("string"))
    errors = records.all_errors([records.field_errors("Valve", text, "number", required=True), records.field_errors("Date", F.date_format("ts", "yyyy-MM-dd"), "date", required=True)])
    return events.select("event_id", F.size(errors).cast("long").alias("errors"), F.array_join(errors, "; ").alias("messages"))


def validate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    quantity, number = F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string")
    marked = items.select("l_linenumber", records.valid_ec(quantity).alias("ec"), records.valid_ph(quantity).alias("ph"), records.positive_int(number).alias("cycle"), records.non_negative(quantity).alias("water"))
    return marked.groupBy("l_linenumber").agg(*[F.count_if(c).alias(f"valid_{c}") for c in ("ec", "ph", "cycle", "water")], reports.share(F.col("ph")).alias("ph_share"))


SERIES = {f"ts_{n.lower()}": n for n in SQL_INDEX}
QUERIES = {k: _series(n) for k, n in SERIES.items()} | {
    f.__name__: f
    for f in (
        ts_multi_index, ts_stats, composite_median, qa_bitmask, bbox_filter, region_mean, scene_search_top20, band_expressions, date_spine, report_irrigation, report_status_rules, report_fertigation,
        report_filtered_range, report_recent, distinct_options, first_seen_sites, last30_series, prev_drip_lag, ec_derived, latest_entry, validate_required, validate_ranges,
    )
}
_Q = "floor({} * 1e6 + 0.5) / 1e6 AS {}"
ORACLES = {k: _series_sql(n) for k, n in SERIES.items()} | {
    "ts_multi_index": f"WITH {PIXELS_SQL}, s AS ({_ALL_SERIES}) SELECT index, strftime(time, '%Y-%m-%d') AS date, {_Q.format('value', 'value')} FROM s",
    "ts_stats": f"WITH {PIXELS_SQL}, s AS ({_ALL_SERIES}) SELECT index, {_Q.format('avg(value)', 'mean')}, {_Q.format('quantile_cont(value, 0.5)', 'median')}, {_Q.format('min(value)', 'min')}, {_Q.format('max(value)', 'max')}, count(value) AS count FROM s GROUP BY index",
    "composite_median": f"WITH {PIXELS_SQL} SELECT x, y, {_Q.format('quantile_cont(B04, 0.5)', 'B04')}, {_Q.format('quantile_cont(B08, 0.5)', 'B08')} FROM pixels WHERE {CLEAR} GROUP BY x, y",
    "qa_bitmask": f"WITH {PIXELS_SQL} SELECT SCL, count(*) AS pixels, {_Q.format('avg((B08 / 10000 - B04 / 10000) / nullif(B08 / 10000 + B04 / 10000, 0))', 'mean_ndvi')} FROM pixels WHERE QA60 & 3072 = 0 GROUP BY SCL",
    "bbox_filter": f"WITH {PIXELS_SQL} SELECT y, count(*) AS pixels, min(x) AS west, max(x) AS east FROM pixels WHERE x BETWEEN 100 AND 900 AND y BETWEEN 10 AND 60 GROUP BY y",
    "region_mean": f"WITH {PIXELS_SQL} SELECT {_Q.format('avg(' + SQL_INDEX['NDVI'] + ')', 'mean')} FROM pixels WHERE {CLEAR} AND x BETWEEN 100 AND 900 AND y BETWEEN 10 AND 60",
    "scene_search_top20": f"""WITH {PIXELS_SQL}, s AS (SELECT time, min(cloud_cover) AS c, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north FROM pixels GROUP BY time)
        SELECT strftime(time, '%Y%m%d') AS scene_id, strftime(time, '%Y-%m-%d') AS date, floor(c * 100 + 0.5) / 100 AS cloud_cover, west, south, east, north FROM s
        WHERE time >= '1995-01-01' AND time <= '1996-12-31 23:59:59' AND c < 1.0 ORDER BY time DESC LIMIT 20""",
    "band_expressions": f"WITH {PIXELS_SQL} SELECT SCL, {_Q.format('avg((B08 - B04) / (B08 + B04))', 'ndvi')}, {_Q.format('avg(2.5::DOUBLE * (B08 - B04) / (B08 + 2.4::DOUBLE * B04 + 1))', 'evi2')} FROM pixels WHERE {CLEAR} GROUP BY SCL",
    "date_spine": """SELECT strftime(d, '%Y-%m-%d') AS date, count(l_shipdate) AS scenes
        FROM (SELECT unnest(generate_series(DATE '1997-06-17', DATE '1997-06-30', INTERVAL 1 DAY)) AS d) LEFT JOIN lineitem ON l_shipdate::DATE = d::DATE GROUP BY d""",
    "report_irrigation": f"{_STATS_SQL} SELECT * FROM stats",
    "report_status_rules": f"""{_STATS_SQL} SELECT site, project,
        CASE WHEN mean_drain_percent < 10 THEN 'Critically Low' WHEN mean_drain_percent > 30 THEN 'High' ELSE 'Optimal' END AS drain_status,
        CASE WHEN mean_ec_out > mean_ec_in * 1.25 THEN 'Salt Accumulation' WHEN mean_ec_out < mean_ec_in * 0.8 THEN 'Nutrient Depletion' ELSE 'Balanced' END AS ec_status,
        CASE WHEN mean_ph_out < 5.5 THEN 'Acidic' WHEN mean_ph_out > 6.8 THEN 'Alkaline' ELSE 'Optimal' END AS ph_status,
        2 * (mean_drain_percent < 10)::BIGINT + (mean_drain_percent > 30)::BIGINT + (mean_ec_out > mean_ec_in * 1.25)::BIGINT + (mean_ec_out < mean_ec_in * 0.8)::BIGINT
            + (mean_ph_out < 5.5)::BIGINT + (mean_ph_out > 6.8)::BIGINT AS advised,
        floor((100 - mean_drain_percent) * 100 + 0.5) / 100 AS retention FROM stats""",
    "report_fertigation": """SELECT l_returnflag AS site, count(*) AS entries, floor(sum(v) * 100 + 0.5) / 100 AS volume, floor(sum(v) / count(*) * 100 + 0.5) / 100 AS mean_volume,
        sum(l_linenumber * (l_suppkey % 4))::DOUBLE AS hours, min(strftime(l_shipdate, '%Y-%m-%d')) AS first_date, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_date
        FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_quantity END AS v FROM lineitem) GROUP BY l_returnflag""",
    "report_filtered_range": "SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) AS entries FROM lineitem WHERE l_shipdate >= '1995-03-01' AND l_shipdate <= '1995-03-31' AND l_returnflag = 'A' GROUP BY 1",
    "report_recent": "SELECT l_returnflag AS site, count(*) AS entries FROM lineitem WHERE l_shipdate >= '1996-05-08 12:00:00' AND l_shipdate <= '1996-05-15 12:00:00' GROUP BY 1",
    "distinct_options": "SELECT DISTINCT p_brand FROM part WHERE p_brand <> ''",
    "first_seen_sites": "SELECT event_type, min(event_id) AS first_seq FROM events GROUP BY 1",
    "last30_series": "SELECT ts, event_id, floor(value * 1e4 + 0.5) / 1e4 AS value FROM events ORDER BY ts DESC, event_id DESC LIMIT 30",
    "prev_drip_lag": f"{_EC_SQL} SELECT event_id, drip, previous FROM r",
    "ec_derived": f"""{_EC_SQL}, n AS (SELECT *, coalesce(drip, 0) AS d, coalesce(drip, 0) * 12 AS n FROM r)
        SELECT event_id, n AS n_drip, CASE WHEN n = 0 THEN 0.0 ELSE floor((100 * ((event_id % 50) * 1.0::DOUBLE) / n + 2.220446049250313e-16) * 100 + 0.5) / 100 END AS drain_percent,
            floor((1.5::DOUBLE * floor(user_id % 7 + 0.9::DOUBLE) + 2.220446049250313e-16) * 1000 + 0.5) / 1000 AS total_water,
            floor(((d + previous) / 2 * 24400 / 1e6 + 2.220446049250313e-16) * 1e6 + 0.5) / 1e6 AS calculated_water FROM n""",
    "latest_entry": "SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "validate_required": """SELECT event_id, (event_type IN ('view', 'error'))::BIGINT AS errors,
        CASE event_type WHEN 'view' THEN 'Valve: Required' WHEN 'error' THEN 'Valve: Must be a number' ELSE '' END AS messages FROM events""",
    "validate_ranges": """SELECT l_linenumber, count(*) FILTER (l_quantity BETWEEN 0 AND 10) AS valid_ec, count(*) FILTER (l_quantity BETWEEN 0 AND 14) AS valid_ph, count(*) AS valid_cycle,
        count(*) FILTER (l_quantity >= 0) AS valid_water, floor(100.0::DOUBLE * count(*) FILTER (l_quantity BETWEEN 0 AND 14) / count(*) + 0.5)::BIGINT AS ph_share FROM lineitem GROUP BY l_linenumber""",
}
