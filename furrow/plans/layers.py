"""Queries over layers' attributes, classes and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import geo, js
from furrow.operators import layers
from furrow.plans.tables import table

JENKS_CLASSES = 4


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    props = F.create_map(*[x for n in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice") for x in (F.lit(n), F.col(n).cast("string"))])
    return parts.select(F.col("p_partkey").alias("seq"), props.alias("props"))


def field_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.field_names(_features(spark, sf_dir), sample=None)


def numeric_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.numeric_fields(_features(spark, sf_dir), sample=None)


def category_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.top_categories(table(spark, sf_dir, "part"), "p_brand", 12)


def _breaks(found: DataFrame) -> DataFrame:
    return found.select(F.posexplode("breaks").alias("place", "value")).select("place", js.quantised(F.col("value")).alias("value"))


def breaks_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaks(layers.equal_breaks(table(spark, sf_dir, "customer"), "c_acctbal", 5))


def breaks_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaks(layers.quantile_breaks(table(spark, sf_dir, "customer"), "c_acctbal", 5))


def class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = F.array(*[F.lit(v) for v in (1000.0, 3000.0, 5000.0, 7000.0)])
    customers = table(spark, sf_dir, "customer").withColumn("class", layers.class_index(F.col("c_acctbal"), limits))
    return customers.groupBy("class").agg(F.count(F.lit(1)).alias("features")).withColumn("colour", geo.class_colour(F.col("class"), "viridis", 3))


def threshold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.above_threshold(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


def breaks_jenks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), "c_mktsegment", "c_acctbal")
    found = layers.natural_breaks_by(customers, ["c_mktsegment"], "c_acctbal", JENKS_CLASSES)
    return found.select("c_mktsegment", F.posexplode("breaks").alias("place", "value")).select("c_mktsegment", "place", js.quantised(F.col("value")).alias("value"))


def eav_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.attributes_long(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


def eav_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("geo_id"), F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_orderpriority")
    long = layers.attributes_long(orders, "geo_id", ["o_orderstatus", "o_orderpriority"], seq=F.col("seq"))
    found = layers.attributes_latest(long, "geo_id", "seq")
    return found.select("geo_id", *[F.try_element_at("attributes", F.lit(n)).alias(n) for n in ("o_orderstatus", "o_orderpriority")])


def popup_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("Name"), F.col("s_name"), F.lit("name"), F.lit("hidden"), F.lit("balance"), F.format_string("%.2f", "s_acctbal"), F.lit("blank"), F.lit(" "), F.lit("City"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    shown = table(spark, sf_dir, "supplier").select("s_suppkey", layers.title(props).alias("title"), layers.display_fields(props).alias("fields"))
    return shown.select("s_suppkey", "title", F.posexplode("fields").alias("place", "f")).select("s_suppkey", "title", "place", "f.label", "f.value")


def feature_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("fid"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_nationkey").cast("string")), F.lit("x"), F.lit("y"))
    ident = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", layers.feature_key(ident, props, F.col("c_custkey")).alias("feature_key"))


def bbox_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


def scale_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("double").alias("zoom"))
    return nations.select("n_nationkey", js.quantised(geo.scale_from_zoom(F.col("zoom")), 3).alias("scale"), js.quantised(geo.metres_per_pixel(F.lit(0.0), F.col("zoom")), 3).alias("metres"), js.quantised(geo.zoom_from_scale(geo.scale_from_zoom(F.col("zoom"))), 6).alias("zoom"))


def wkt_to_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    wkt = F.when(k % 3 == 0, F.format_string("POLYGON((%d 0, %d 2, %d 4, %d 0), (9 9, 8 8, 7 7, 9 9))", k, k + 2, k + 1, k)).when(k % 3 == 1, F.format_string("POINT(%d %d)", k, k + 1)).otherwise("polygon((1 1))")
    ring = geo.wkt_ring(wkt)
    found = table(spark, sf_dir, "supplier").select("s_suppkey", ring.alias("ring")).filter("ring IS NOT NULL")
    return found.select("s_suppkey", F.size("ring").alias("vertices"), geo.bounds(F.col("ring"))["west"].alias("west"), geo.bounds(F.col("ring"))["north"].alias("north"), geo.bounds_centre(F.col("ring"))[0].alias("centre_x"), geo.middle_vertex(F.col("ring"))[1].alias("middle_y"))


def field_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(t) for t in ("esriFieldTypeDate", "esriFieldTypeInteger", "esriFieldTypeDouble", "esriFieldTypeOID", "esriFieldTypeString")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(layers.field_kind(kinds).alias("kind")).agg(F.count(F.lit(1)).alias("fields"))


QUERIES = {f.__name__: f for f in (field_discovery, numeric_fields, category_topk, breaks_equal, breaks_quantile, class_index, threshold_features, breaks_jenks, eav_unpivot, eav_last_wins, popup_fields, feature_key, bbox_agg, scale_zoom, wkt_to_coords, field_kinds)}
# Least squares by levels: cost and first value of the last class of the first j values in k classes; the smallest split of equal costs.
_JENKS = (
    """WITH v AS MATERIALIZED (SELECT c_mktsegment AS g, c_acctbal::DOUBLE AS x, row_number() OVER w AS i, sum(c_acctbal::DOUBLE) OVER w AS s, sum(c_acctbal::DOUBLE * c_acctbal::DOUBLE) OVER w AS q FROM customer
        WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey ROWS UNBOUNDED PRECEDING)), p AS MATERIALIZED (SELECT g, i, s, q FROM v UNION ALL SELECT DISTINCT g, 0, 0, 0 FROM v),
        k1 AS MATERIALIZED (SELECT g, i AS j, q - s * s / i AS c, 0::BIGINT AS a FROM v)"""
    + "".join(
        f""", k{k} AS MATERIALIZED (SELECT b.g, b.i AS j, min(l.c + (b.q - p.q) - (b.s - p.s) * (b.s - p.s) / (b.i - p.i)) AS c, arg_min(l.j, l.c + (b.q - p.q) - (b.s - p.s) * (b.s - p.s) / (b.i - p.i)) AS a
            FROM k{k - 1} l JOIN p ON p.g = l.g AND p.i = l.j JOIN v b ON b.g = l.g AND b.i > l.j WHERE l.j >= {k - 1} GROUP BY ALL)"""
        for k in range(2, JENKS_CLASSES + 1)
    )
    + f""", e{JENKS_CLASSES} AS (SELECT g, max(i) AS j FROM v GROUP BY g)"""
    + "".join(f", e{k - 1} AS (SELECT l.g, l.a AS j FROM k{k} l JOIN e{k} ON l.g = e{k}.g AND l.j = e{k}.j)" for k in range(JENKS_CLASSES, 1, -1))
    + """ SELECT g AS c_mktsegment, 0::INT AS place, floor(min(x) * 1e6 + 0.5) / 1e6 AS value FROM v GROUP BY g"""
    + "".join(f" UNION ALL SELECT v.g, {k}, floor(v.x * 1e6 + 0.5) / 1e6 FROM v JOIN e{k} ON v.g = e{k}.g AND v.i = e{k}.j + 1" for k in range(1, JENKS_CLASSES))
    + f" UNION ALL SELECT g, {JENKS_CLASSES}, floor(max(x) * 1e6 + 0.5) / 1e6 FROM v GROUP BY g"
)
ORACLES = {
    "field_discovery": "SELECT unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS field",
    "numeric_fields": """SELECT field FROM (SELECT field, avg((try_cast(value AS DOUBLE) IS NOT NULL)::INT) AS share FROM (
        SELECT unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS field, unnest([p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR]) AS value FROM part) GROUP BY field) WHERE share >= 0.6""",
    "category_topk": "SELECT p_brand, count(*) AS features FROM part WHERE p_brand <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "breaks_equal": "SELECT i::INT AS place, floor((l + (h - l) * i / 5) * 1e6 + 0.5) / 1e6 AS value FROM (SELECT min(c_acctbal) AS l, max(c_acctbal) AS h FROM customer), generate_series(0, 5) AS g(i)",
    "breaks_jenks": _JENKS,
    "breaks_quantile": """SELECT (generate_subscripts(b, 1) - 1)::INT AS place, floor(unnest(b) * 1e6 + 0.5) / 1e6 AS value
        FROM (SELECT quantile_cont(c_acctbal, [0.0::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE, 1.0::DOUBLE]) AS b FROM customer)""",
    "class_index": """SELECT CASE WHEN c_acctbal >= 1000 AND c_acctbal < 3000 THEN 0 WHEN c_acctbal >= 3000 AND c_acctbal < 5000 THEN 1 ELSE 2 END::INT AS class, count(*) AS features,
        ['#440154', '#21918c', '#fde725'][class + 1] AS colour FROM customer GROUP BY class""",
    "threshold_features": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.8::DOUBLE) FROM customer)",
    "eav_unpivot": "SELECT c_custkey, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS field, unnest([c_name, c_nationkey::VARCHAR, c_mktsegment]) AS value FROM customer",
    "eav_last_wins": "SELECT o_custkey AS geo_id, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1",
    "popup_fields": """SELECT s_suppkey, s_name AS title, unnest([0, 1, 2])::INT AS place, unnest(['name', 'City', 'balance']) AS label,
        unnest(['hidden', 'N' || s_nationkey::VARCHAR, printf('%.2f', s_acctbal)]) AS value FROM supplier""",
    "feature_key": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR WHEN c_custkey % 3 <> 0 THEN 'fid:' || c_nationkey::VARCHAR ELSE 'idx:' || c_custkey::VARCHAR END AS feature_key FROM customer""",
    "bbox_agg": "SELECT l_returnflag, min(l_partkey) AS west, min(l_suppkey) AS south, max(l_partkey) AS east, max(l_suppkey) AS north FROM lineitem GROUP BY 1",
    "scale_zoom": """SELECT n_nationkey, floor(591657550.5::DOUBLE / pow(2.0::DOUBLE, n_nationkey) * 1e3 + 0.5) / 1e3 AS scale,
        floor(40075016.68557849::DOUBLE / (512.0::DOUBLE * pow(2.0::DOUBLE, n_nationkey)) * 1e3 + 0.5) / 1e3 AS metres, n_nationkey::DOUBLE AS zoom FROM nation""",
    "wkt_to_coords": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 1 END::INT AS vertices, s_suppkey::DOUBLE AS west, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE s_suppkey + 1 END::DOUBLE AS north,
        CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 ELSE s_suppkey END::DOUBLE AS centre_x, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE s_suppkey + 1 END::DOUBLE AS middle_y FROM supplier WHERE s_suppkey % 3 <> 2""",
    "field_kinds": "SELECT ['date', 'number', 'number', 'number', 'text'][(p_partkey % 5 + 1)::INT] AS kind, count(*) AS fields FROM part GROUP BY 1",
}
