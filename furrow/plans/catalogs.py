"""Queries over layer catalogs, styles, users and new locations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import geo, js
from furrow.operators import layers, locations, schema, styling
from furrow.plans.tables import table
from furrow.session import shared_folder
from furrow.sources import arcgis


def hidden_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = schema.visible(table(spark, sf_dir, "supplier"), ["s_acctbal", "gone"])
    return schema.move_field(schema.rename_field(schema.add_field(shown, "grade", "number", "2"), "s_name", "title"), "grade", 0)


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 3 == 0, F.concat(F.lit("arcgis:"), "s_name")).when(k % 3 == 1, F.concat(F.lit("https://h/"), k.cast("string"))).otherwise(F.lit("other")).alias("source"))
    names = table(spark, sf_dir, "supplier").select(F.when(k % 3 == 1, F.concat(F.lit("url:https://h/"), k.cast("string"))).otherwise(F.col("s_name")).alias("id"), F.concat(F.lit("Layer "), k.cast("string")).alias("name"))
    return schema.display_names(sources, "source", names).select("s_suppkey", "display_name", schema.group_key(F.col("source")).alias("group_key"))


def layer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.concat(F.element_at(F.array(*[F.lit(p) for p in ("arcgis:", "geojson:", "https://", "plain")]), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").groupBy(schema.group_key(ids).alias("group_key")).agg(F.count(F.lit(1)).alias("layers"))


def layer_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "Point").alias("geometry_type"), F.col("o_orderkey").alias("id"))
    catalog = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name")).agg(F.collect_list(feature).alias("features"))
    return schema.layer_summary(catalog)


def renderer_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    unique = styling.unique_symbol(props, ["brand", "size"], {"Brand#11, 1": "first", "Brand#12, 2": "second"}, "other")
    breaks = styling.break_symbol(F.col("p_retailprice").cast("double"), [(1000.0, "low"), (1500.0, "middle")], "high")
    return table(spark, sf_dir, "part").groupBy(unique.alias("symbol"), breaks.alias("price")).agg(F.count(F.lit(1)).alias("parts"))


def legend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    infos = table(spark, sf_dir, "nation").select(k.alias("place"), F.when(k % 3 == 0, F.col("n_name")).alias("label"), F.when(k % 3 == 1, F.col("n_name")).alias("value"), (k * 10.0).alias("largest"), F.when(k != 2, F.concat(F.lit("s"), k.cast("string"))).alias("symbol"))
    return styling.legend(infos, "default", 12).select("label", "symbol")


def feature_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("point"), F.lit("line"), F.lit("polygon")), (F.col("c_custkey") % 3 + 1).cast("int"))
    limits = F.array(*[F.lit(v) for v in (-1000.0, 2500.0, 6000.0, 10000.0)])
    style = styling.feature_style(kind, "color_size", layers.class_index(F.col("c_acctbal"), limits), geo.ramp_colours("blues", 3), geo.class_widths(3), ["1 5"] * 3)
    return table(spark, sf_dir, "customer").select("c_custkey", style.alias("s")).select("c_custkey", "s.color", "s.fill_color", "s.weight", "s.fill_opacity")


def service_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgba = F.array(*[(F.col("s_suppkey") * n % 300).cast("double") for n in (1, 3, 7, 11)])
    made = table(spark, sf_dir, "supplier").select("s_suppkey", styling.colour_and_opacity(rgba, 0.5).alias("c"), styling.dash_array(F.when(F.col("s_suppkey") % 2 == 0, "esriSLSDashDot").otherwise("esriSLSSolid")).alias("dashes"))
    return made.select("s_suppkey", "c.hex", js.quantised(F.col("c.opacity"), 4).alias("opacity"), "dashes")


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in (" ADMIN ", "admin_manager", "Editor", "boss", "manager")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    users = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.concat("c_name", F.lit(" "))).alias("email"), F.lit("").alias("name"), role.alias("role"), F.col("c_mktsegment").alias("scope"), F.lit(None).cast("string").alias("status"))
    return schema.normal_users(users).select("email", "name", "role", "status", schema.allowed("admin.users.manage", F.col("role")).alias("manages"))


def _new_locations(spark: SparkSession, sf_dir: str) -> locations.Inserted:
    k = F.col("s_suppkey")
    forms = F.array(F.struct(F.lit("f1").alias("id"), F.when(k % 11 == 0, F.array(F.lit("own"))).otherwise(F.array(F.lit("read"), F.lit("update"))).alias("permissions")))
    new = table(spark, sf_dir, "supplier").select(
        k.alias("geo_id"), k.alias("seq"), F.lit("2024-01-01").alias("ts"), F.lit("SA").alias("country"), F.when(k % 5 == 0, F.lit(" Site ")).otherwise(F.col("s_name")).alias("site"), F.lit("p").alias("project"), F.lit("").alias("project_id"),
        F.when(k % 7 == 0, "toolong").otherwise("a1b").alias("zone_id"), F.lit("abcd1234").alias("code_id"), F.lit("2024-01-01").alias("date"), F.lit("POINT(1 2)").alias("wkt"), F.lit("Point").alias("geometry_type"),
        F.array(F.array(F.array(F.lit(1.0), F.lit(2.0)))).alias("rings"), forms.alias("forms"),
    )
    return locations.insert(table(spark, sf_dir, "supplier").filter("s_suppkey = 1").select(F.col("s_name").alias("site")), new)


def location_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_locations(spark, sf_dir).rejected.select("geo_id", F.array_join("errors", "; ").alias("errors"))


def location_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_locations(spark, sf_dir).attributes.groupBy("field").agg(F.count(F.lit(1)).alias("values"))


def location_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_locations(spark, sf_dir).links.select("geo_id", "form_id", F.array_join("permissions", ",").alias("permissions"))


def service_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a service's recorded answers of a hundred features each, read back by named and typed fields."""
    suppliers = table(spark, sf_dir, "supplier")
    attributes = F.struct(F.col("s_suppkey").alias("OBJECTID"), F.col("s_name").alias("Farm_Code"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("Balance"), F.lit("not asked for").alias("Other"))
    feature = F.struct(attributes.alias("attributes"), F.struct(F.col("s_nationkey").alias("x"), (F.col("s_suppkey") % 80).alias("y")).alias("geometry"))
    answers = suppliers.groupBy(F.floor(F.col("s_suppkey") / 100).alias("page")).agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct("features")))
    folder = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    answers.write.text(folder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(arcgis.ArcGisSource)
    found = spark.read.format("arcgis").options(path=folder, fields="OBJECTID long, Farm_Code string, Balance double").load()
    return found.filter((F.col("Balance") > 0) | F.col("Balance").isNull()).select(F.col("OBJECTID").alias("id"), F.col("Farm_Code").alias("code"), F.col("Balance").alias("balance"), "x", "y")


QUERIES = {f.__name__: f for f in (service_fields, hidden_columns, display_names, layer_groups, layer_summaries, renderer_symbols, legend_rows, feature_styles, service_colours, user_roles, location_rejects, location_attributes, location_links)}
_LOCATIONS = """WITH l AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'site' ELSE lower(s_name) END AS site,
    concat_ws('; ', CASE WHEN s_suppkey % 7 = 0 THEN 'zone_id is malformed' END, CASE WHEN s_suppkey % 11 = 0 THEN 'unknown permission' END) AS e FROM supplier),
    g AS (SELECT *, CASE WHEN e <> '' THEN e WHEN row_number() OVER (PARTITION BY site, e = '' ORDER BY k) > 1 OR site = (SELECT lower(s_name) FROM supplier WHERE s_suppkey = 1) THEN 'site must be unique' END AS errors FROM l)"""
ORACLES = {
    "service_fields": """SELECT s_suppkey AS id, s_name AS code, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS balance, s_nationkey::DOUBLE AS x, (s_suppkey % 80)::DOUBLE AS y
        FROM supplier WHERE s_suppkey % 7 = 0 OR s_acctbal > 0""",
    "hidden_columns": "SELECT 2.0::DOUBLE AS grade, s_suppkey, s_name AS title, s_nationkey FROM supplier",
    "display_names": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN 'other' ELSE 'Layer ' || s_suppkey END AS display_name, ['arcgis', 'https', 'custom'][(s_suppkey % 3 + 1)::INT] AS group_key FROM supplier""",
    "layer_groups": "SELECT ['arcgis', 'geojson', 'https', 'custom'][(p_partkey % 4 + 1)::INT] AS group_key, count(*) AS layers FROM part GROUP BY 1",
    "layer_summaries": "SELECT o_custkey AS id, o_orderpriority AS name, CASE WHEN bool_or(o_orderkey % 2 = 0) THEN 'Point' ELSE 'Unknown' END AS geometry_type, count(*)::INT AS records FROM orders GROUP BY ALL",
    "renderer_symbols": """SELECT CASE WHEN p_brand = 'Brand#11' AND p_size = 1 THEN 'first' WHEN p_brand = 'Brand#12' AND p_size = 2 THEN 'second' ELSE 'other' END AS symbol,
        CASE WHEN p_retailprice <= 1000 THEN 'low' WHEN p_retailprice <= 1500 THEN 'middle' ELSE 'high' END AS price, count(*) AS parts FROM part GROUP BY ALL""",
    "legend_rows": """SELECT CASE WHEN n_nationkey % 3 = 2 THEN '≤ ' || (n_nationkey * 10) ELSE n_name END AS label, 's' || n_nationkey AS symbol FROM nation WHERE n_nationkey < 12 AND n_nationkey <> 2 UNION ALL SELECT 'Other', 'default'""",
    "feature_styles": """WITH c AS (SELECT c_custkey, c_custkey % 3 AS k, CASE WHEN c_acctbal >= -1000 AND c_acctbal < 2500 THEN 0 WHEN c_acctbal >= 2500 AND c_acctbal < 6000 THEN 1 ELSE 2 END AS i FROM customer)
        SELECT c_custkey, CASE k WHEN 2 THEN printf('#%02x%02x%02x', floor([239, 96, 30][i + 1] * 0.75 + 0.5)::INT, floor([246, 165, 58][i + 1] * 0.75 + 0.5)::INT, floor([255, 250, 138][i + 1] * 0.75 + 0.5)::INT) WHEN 1 THEN ['#eff6ff', '#60a5fa', '#1e3a8a'][i + 1] ELSE '#22c55e' END AS color,
            CASE k WHEN 2 THEN ['#eff6ff', '#60a5fa', '#1e3a8a'][i + 1] ELSE '#22c55e' END AS fill_color, CASE WHEN k > 0 THEN 1.5::DOUBLE + 2.25::DOUBLE * i ELSE 2.0 END AS weight, CASE k WHEN 2 THEN 0.35::DOUBLE ELSE 0.0 END AS fill_opacity FROM c""",
    "service_colours": """SELECT s_suppkey, lower(printf('#%02x%02x%02x', least(s_suppkey % 300, 255), least(s_suppkey * 3 % 300, 255), least(s_suppkey * 7 % 300, 255))) AS hex,
        floor(least(s_suppkey * 11 % 300, 255) / 255.0::DOUBLE * 0.5::DOUBLE * 1e4 + 0.5) / 1e4 AS opacity, CASE WHEN s_suppkey % 2 = 0 THEN '8 4 2 4' END AS dashes FROM supplier""",
    "user_roles": """SELECT c_name AS email, c_name AS name, ['Admin', 'Admin Manager', 'Editor', 'Viewer', 'Manager'][(c_custkey % 5 + 1)::INT] AS role, 'Active' AS status, c_custkey % 5 IN (0, 1, 4) AS manages FROM customer WHERE c_custkey % 7 <> 0""",
    "location_rejects": f"{_LOCATIONS} SELECT k AS geo_id, errors FROM g WHERE errors IS NOT NULL",
    "location_attributes": f"{_LOCATIONS} SELECT unnest(['country', 'site', 'project', 'project_id', 'zone_id', 'code_id', 'date']) AS field, (SELECT count(*) FROM g WHERE errors IS NULL) AS \"values\"",
    "location_links": f"{_LOCATIONS} SELECT k AS geo_id, 'f1' AS form_id, 'read,update' AS permissions FROM g WHERE errors IS NULL",
}
