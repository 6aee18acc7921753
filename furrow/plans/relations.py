"""Queries over relationships, domains, catalog changes, paging, search and visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import catalog, relate
from furrow.operators.relate import Relationship
from furrow.plans.tables import table

ORDERS = Relationship("orders", "customer", "orders", "one_to_many", "c_custkey", "o_custkey", fields=("o_orderkey", "o_orderstatus"))
REGION = Relationship("region", "nation", "region", "one_to_one", "n_regionkey", "r_regionkey", fields=("r_name",))
SUPPLIERS = Relationship("suppliers", "part", "supplier", "many_to_many", "p_partkey", "s_suppkey", fields=("s_name",), junction="lineitem", junction_source="l_partkey", junction_target="l_suppkey")


def rel_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relate.resolve(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), ORDERS)
    return found.groupBy("c_custkey").agg(F.count("orders_o_orderkey").alias("orders"), F.min("orders_o_orderkey").alias("first_order"))


def rel_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.resolve(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), REGION).select("n_name", "region_r_name")


def rel_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.resolve(table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), SUPPLIERS, table(spark, sf_dir, "lineitem")).select("p_partkey", "supplier_s_name")


def rel_key_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumn("raw", F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))))
    segments = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("segment")).distinct()
    relation = Relationship("segment", "customer", "segment", "one_to_one", "raw", "segment", transform="trim")
    return relate.resolve(customers, segments, relation).select("c_custkey", F.col("segment_segment").alias("segment"), "key_missing")


def domain_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"))
    own = spark.createDataFrame([(1, 1, "HOME")], "subtype int, code int, name string")
    nations = table(spark, sf_dir, "nation").withColumn("subtype", F.col("n_nationkey") % 2)
    return relate.decode(nations, "n_regionkey", domain.filter("code <> 4"), "subtype", own).select("n_nationkey", "n_regionkey_name", "n_regionkey_title")


def domain_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    named = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("other").alias("label"))
    return relate.encode(named, "label", domain)


def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def semi_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    left = relate.cascade(customers, "c_custkey", customers.filter("c_acctbal < 0"), {"orders": (orders, "o_custkey")})
    return left["parents"].select(F.lit("customer").alias("table"), F.col("c_custkey").alias("key")).unionByName(left["orders"].select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("key")))


def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicated_keys(table(spark, sf_dir, "lineitem"), F.concat_ws(":", "l_orderkey", "l_linenumber"))


def farm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    asked = suppliers.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.substring("s_name", 1, 6)).alias("term"))
    return relate.lookup_by_code(asked, suppliers, "term", "s_name")


def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"))
    new = spark.createDataFrame([("ATLANTIS", 1), ("ATLANTIS", 2), (" ", 3), (None, 4)], "key string, seq int").unionByName(nations.limit(0).select("key", F.lit(0).alias("seq")))
    base = nations
    kept, rejected = catalog.insert(base, new, "key")
    return kept.select("key", F.lit("kept").alias("reason")).unionByName(rejected.select("key", "reason"))


def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select("c_custkey", F.lit(1).alias("seq"), F.lit(None).cast("string").alias("c_name"), F.lit("PATCHED").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("c_name"))).otherwise(F.array(F.lit("c_mktsegment"))).alias("patched"))
    return catalog.merge(base, patch, "c_custkey", ["c_name", "c_mktsegment"])


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return catalog.delete(customers, customers.filter("c_acctbal < 0"), "c_custkey").select("c_custkey")


def replace_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("geo_id"), F.col("o_orderpriority").alias("form_id")).distinct()
    new = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("geo_id"), F.lit("NEW").alias("form_id"))
    return catalog.replace_group(links, new, "geo_id")


def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.keep_first(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, total = catalog.page(table(spark, sf_dir, "customer"), [F.col("c_custkey")], limit=25, offset=50)
    return found.select("c_custkey", "c_name", F.lit(total).cast("long").alias("total"))


def ranked_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.suggest(table(spark, sf_dir, "supplier").select("s_name"), "s_name", "supplier#0000000")


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    valves = table(spark, sf_dir, "customer").select(F.concat(F.lit("V"), F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, "b").otherwise("")).alias("valve"))
    return valves.select("valve", catalog.natural_key(F.col("valve")).alias("sort_key")).orderBy("sort_key")


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(table(spark, sf_dir, "part"), "Brand#1", ["p_name", "p_brand", "p_type"]).select("p_partkey")


def filter_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.equals_text(table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_size", "18").select("p_partkey")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in catalog.ROLE_RANK]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("scope"), F.col("c_nationkey").alias("managed_by"), role.alias("role"), "c_name")


def rls_visible_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.visible_users(_users(spark, sf_dir), 7, "Admin Manager", "BUILDING").select("user_id", "role")


def role_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.best_role(_users(spark, sf_dir), ["managed_by", "scope"], "role", "user_id")


def capped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest(table(spark, sf_dir, "events"), 200, ["ts", "event_id"]).select("event_id", "event_type")


def capped_log_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest(table(spark, sf_dir, "events"), 50, ["ts", "event_id"], ["event_type"]).select("event_id", "event_type")


def union_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("layer").alias("kind"))
    return layers.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).subtract(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_name", F.lit("found").alias("origin"))
    return catalog.fallback_rows(found, table(spark, sf_dir, "nation").select("n_name", F.lit("fallback").alias("origin")), "n_name")


def farm_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "supplier").select("s_suppkey", F.create_map(F.lit("Farm_Name"), F.col("s_name"), F.lit("Area"), F.col("s_nationkey").cast("string")).alias("props"))
    targets = spark.createDataFrame([("a", ["Farm_Name"]), ("b", ["Farm_Name", "Area"])], "target string, enabled array<string>")
    return catalog.fan_out(updates, targets).select("s_suppkey", "target", F.explode("props").alias("field", "value"))


def relationship_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return nations.select("n_regionkey", F.array_join("names", ",").alias("names"))


QUERIES = {
    f.__name__: f
    for f in (
        rel_one_to_many, rel_one_to_one, rel_many_to_many, rel_key_transform, domain_decode, domain_encode, anti_missing, semi_selected, cascade_delete, dup_keys, farm_lookup, insert_rows, merge_update, delete_rows,
        replace_links, keep_first, last_wins, page_window, ranked_suggest, natural_sort, search_rows, filter_as_text, rls_visible_users, role_argmax, capped_log, capped_log_by_form, union_layers, set_difference,
        set_intersection, fallback_union, farm_fan_out, relationship_tree,
    )
}
_ROLE = "['Viewer', 'Editor', 'Admin Manager', 'Admin', 'Manager'][(c_custkey % 5 + 1)::INT]"
ORACLES = {
    "rel_one_to_many": "SELECT c_custkey, count(o_orderkey) AS orders, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1",
    "rel_one_to_one": "SELECT n_name, r_name AS region_r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "rel_many_to_many": "SELECT p_partkey, s_name AS supplier_s_name FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey",
    "rel_key_transform": "SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN lower(c_mktsegment) END AS segment, c_custkey % 10 = 0 AS key_missing FROM customer",
    "domain_decode": """SELECT n_nationkey, coalesce(n, n_regionkey::VARCHAR) AS n_regionkey_name, CASE WHEN n IS NULL THEN n_regionkey::VARCHAR ELSE n || ' (code: ' || n_regionkey || ')' END AS n_regionkey_title
        FROM (SELECT *, CASE WHEN n_nationkey % 2 = 1 AND n_regionkey = 1 THEN 'HOME' WHEN n_regionkey <> 4 THEN r_name END AS n FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "domain_encode": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE 'other' END AS label FROM nation",
    "anti_missing": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "semi_selected": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)",
    "cascade_delete": """SELECT 'customer' AS "table", c_custkey AS key FROM customer WHERE NOT c_acctbal < 0 UNION ALL
        SELECT 'orders', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "dup_keys": "SELECT l_orderkey || ':' || l_linenumber AS key, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "farm_lookup": """WITH a AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE substr(s_name, 1, 6) END AS term FROM supplier)
        SELECT term, coalesce((SELECT min(s_name) FROM supplier WHERE s_name = term), (SELECT min(s_name) FROM supplier WHERE starts_with(s_name, term))) AS code FROM a""",
    "insert_rows": "SELECT n_name AS key, 'kept' AS reason FROM nation UNION ALL SELECT 'ATLANTIS', 'kept' UNION ALL SELECT 'ATLANTIS', 'key exists' UNION ALL SELECT ' ', 'key required' UNION ALL SELECT NULL, 'key required'",
    "merge_update": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN NULL ELSE c_name END AS c_name,
        CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 <> 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "delete_rows": "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0",
    "replace_links": """SELECT DISTINCT o_custkey AS geo_id, o_orderpriority AS form_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)
        UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 4 = 0""",
    "keep_first": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "last_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seq FROM events GROUP BY 1",
    "page_window": "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50",
    "ranked_suggest": """SELECT s_name, CASE WHEN t = a THEN 1000 WHEN starts_with(t, a) THEN 900 ELSE 800 END::INT AS score
        FROM (SELECT s_name, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS t, 'SUPPLIER0000000' AS a FROM supplier) WHERE contains(t, a) ORDER BY score DESC, length(s_name), s_name LIMIT 20""",
    "natural_sort": "SELECT valve, 'v' || lpad(len(c_custkey::VARCHAR)::VARCHAR, 9, '0') || c_custkey || CASE WHEN c_nationkey % 2 = 0 THEN 'b' ELSE '' END AS sort_key FROM (SELECT *, 'V' || c_custkey || CASE WHEN c_nationkey % 2 = 0 THEN 'b' ELSE '' END AS valve FROM customer)",
    "search_rows": "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')",
    "filter_as_text": "SELECT p_partkey FROM part WHERE p_size = 18",
    "rls_visible_users": f"SELECT c_custkey AS user_id, {_ROLE} AS role FROM customer WHERE c_custkey = 7 OR (c_mktsegment = 'BUILDING' AND c_nationkey = 7 AND {_ROLE} IN ('Editor', 'Viewer'))",
    "role_argmax": f"SELECT c_nationkey AS managed_by, c_mktsegment AS scope, arg_max({_ROLE}, c_custkey % 5) AS role FROM customer GROUP BY ALL",
    "capped_log": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "capped_log_by_form": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50",
    "union_layers": "SELECT p_partkey AS id, p_name AS name, 'layer' AS kind FROM part UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
    "set_difference": "SELECT p_partkey AS id FROM part EXCEPT SELECT s_suppkey FROM supplier",
    "set_intersection": "SELECT p_partkey AS id FROM part INTERSECT SELECT s_suppkey FROM supplier",
    "fallback_union": "SELECT n_name, CASE WHEN n_regionkey < 3 THEN 'found' ELSE 'fallback' END AS origin FROM nation",
    "farm_fan_out": "SELECT s_suppkey, unnest(['a', 'b', 'b']) AS target, unnest(['Farm_Name', 'Farm_Name', 'Area']) AS field, unnest([s_name, s_name, s_nationkey::VARCHAR]) AS value FROM supplier",
    "relationship_tree": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
}
