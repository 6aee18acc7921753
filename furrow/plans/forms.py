"""Queries over form entries, bindings, farm attributes, layer lists and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions import geo, indices, js, records, text
from furrow.operators import catalog, forms, layers, lists, raster, relate, reports
from furrow.plans.tables import pixels, table


def ec_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "draft").when(k % 3 == 1, "submitted").otherwise("final")
    state = F.when(k % 5 == 0, F.lit('{"sourceIds":[],"valuesBySource":{}}')).otherwise(F.lit('{"sourceIds":["s1"],"selectedFieldsBySource":{"s1":["Cycle"]},"valuesBySource":{"s1":{"Cycle":"2"}}}'))
    body = F.when(k % 7 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{"formKey":"EC","kind":"'), kind, F.lit('","more":1,"state":'), state, F.lit("}")))
    good, bad = forms.accepted_entries(table(spark, sf_dir, "orders").select(k, body.alias("body")))
    accepted = good.select("o_orderkey", F.lit("accepted").alias("status"), F.get("state.sourceIds", 0).alias("detail"))
    return accepted.unionByName(bad.select("o_orderkey", F.lit("rejected").alias("status"), F.array_join("problems", "; ").alias("detail")))


def ec_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    values = F.create_map(F.lit("s1"), F.create_map(F.lit("pH_In"), F.when(k == 1, "acid").otherwise(F.format_string("%.1f", F.col("l_quantity").cast("double") / 2)), F.lit("Cycle"), F.when(k == 2, "1.5").when(k == 3, "0").otherwise(k.cast("string")), F.lit("Site"), F.when(k == 4, " ").otherwise("x")))
    configs = F.create_map(F.lit("s1"), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("enabled"), F.lit(r).alias("required")) for n, e, r in (("Site", True, True), ("Off", False, True), ("Cycle", True, True))]))
    # Forms that are equal in all they are made from are counted first and checked once.
    equal = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    found = equal.select("l_linenumber", F.array_join(forms.submit_errors(values, configs), "; ").alias("errors"), "n")
    return found.groupBy("l_linenumber", "errors").agg(F.sum("n").alias("forms"))


def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [F.when(F.col("p_size") > i, F.lit(f"error {i % 15}")) for i in range(30)]
    found = records.all_errors(texts, 12)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(found).alias("errors"), F.array_join(found, ",").alias("shown"))


def form_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    none = F.lit(None).cast(forms.BINDING)
    base = table(spark, sf_dir, "nation").filter("n_nationkey < 10").select(F.col("n_name").alias("form_key"), none.alias("binding"), F.concat(F.lit("layer "), k.cast("string")).alias("management_layer"))
    config = F.array(F.struct(F.concat(F.lit(" "), F.col("n_name")).alias("name"), (k % 2 == 0).alias("required")), F.struct(F.lit(" ").alias("name"), F.lit(True).alias("required")))
    drafts = table(spark, sf_dir, "nation").filter("n_nationkey >= 5").select(F.col("n_name").alias("form_key"), F.array(F.lit(" s1 "), F.lit("")).alias("source_ids"), F.create_map(F.lit("s1"), config).alias("configs"))
    saved = forms.save_bindings(base, drafts)
    field = F.get(F.try_element_at("binding.fieldConfigsBySource", F.lit("s1")), 0)
    return saved.select("form_key", "management_layer", F.array_join("binding.sourceIds", ",").alias("sources"), field["name"].alias("field"), field["required"].alias("required"))


def farm_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    attributes = F.create_map(F.lit("Farm_Code"), F.concat(F.lit(" F"), k.cast("string")), F.lit("Farm_Name"), F.col("s_name"), F.lit("Project_Code"), F.lit("P"), F.lit("Last_Update"), F.when(k % 2 == 0, (k * 86_400_000).cast("string")).when(k % 3 == 0, "2024-05-06T07:08"))
    updates = forms.farm_attributes(attributes, F.when(k % 5 != 0, (k / 10).cast("double")), F.when(k % 5 != 0, (k / 20).cast("double")))
    enabled = F.array(*[F.lit(n) for n in ("Farm_Code", "ProjectCode", "Location", "LAT", "edit_date", "Country")])
    kept = F.map_filter(updates, lambda name, _: F.array_contains(enabled, name))
    filled = forms.filled(F.create_map(F.lit("Country"), F.lit("old"), F.lit("Own"), F.lit("kept")), kept)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(filled).alias("field", "value"))


def farm_best_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's options are its suppliers, in the order of their keys, for the term that the nation's number is."""
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("term"))
    options = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("term"), F.col("s_suppkey").cast("string").alias("code"), F.col("s_suppkey").alias("seq"))
    return relate.best_option(asked, options, "term", "code", "seq")


def farm_short_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of one character and more against codes without a common beginning."""
    farms = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("code"))
    asked = table(spark, sf_dir, "nation").select(F.explode(F.array(F.col("n_nationkey").cast("string"), (F.col("n_nationkey") + 990).cast("string"), (F.col("n_nationkey") * 101 + 1000).cast("string"))).alias("term")).distinct()
    return relate.lookup_by_code(asked, farms, "term", "code", scored=True)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        F.when(e % 11 != 0, F.concat(F.lit(" "), e.cast("string"))).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.when(e % 7 == 0, " ").otherwise("user").alias("entity"), F.col("event_type").alias("action"),
        F.when(e % 2 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("entity_id"), F.lit(" a@x ").alias("actor_email"), F.lit(None).cast("map<string,string>").alias("meta"),
    )
    return forms.audit_entries(raw).drop("meta")


def location_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("geo_id"), F.col("o_orderkey").alias("form_id"), F.array(F.lit("read")).alias("permissions"), F.col("o_orderpriority").alias("created_at"))
    catalog_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("form_id"), F.col("o_orderstatus").alias("project"))
    found = forms.forms_of(links, "7", "F", catalog_)
    return found.select("form_id", F.array_join("permissions", ",").alias("permissions"), "created_at")


def shown_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    catalog_ = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 4 != 3, k % 4 == 0).alias("visible"), F.when(k % 3 == 0, "geojson").otherwise("arcgis").alias("type"), F.when(k % 5 != 0, F.col("p_name")).alias("data"))
    return forms.visible_layers(catalog_).select("id", F.lit("legend").alias("kind")).unionByName(forms.visible_layers(catalog_, "geojson").select("id", F.lit("map").alias("kind")))


def merge_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order patches its customer's name and segment, one of them at a time: the last of each counts."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("c_name"), F.col("o_orderpriority").alias("c_mktsegment"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("c_name"))).otherwise(F.array(F.lit("c_mktsegment"))).alias("patched"), F.col("o_orderkey").alias("seq"))
    return catalog.merge(base, patch, "c_custkey", ["c_name", "c_mktsegment"], "seq")


def replace_by_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("geo_id"), F.col("o_orderkey").alias("form_id"))
    new = links.filter("geo_id % 4 = 0 AND form_id % 2 = 0")
    groups = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("geo_id"))
    return catalog.replace_group(links, new, "geo_id", groups)


def decode_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain in which codes and names come several times."""
    domain = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_mktsegment").alias("name"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    decoded = relate.decode(nations, "n_nationkey", domain).select("n_nationkey", "n_nationkey_name")
    return relate.encode(decoded.withColumn("back", F.col("n_nationkey_name")), "back", domain)


def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pages = catalog.record_page(table(spark, sf_dir, "customer").select("c_custkey"), [F.col("c_custkey")], 200, 10_000)
    return found.withColumn("pages", F.lit(pages).cast("long"))


def layers_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten layers of each mode, both ways."""
    k = F.col("p_partkey")
    catalog_ = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("L"), (k % 50).cast("string")).alias("name"), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("created_at"))
    order = table(spark, sf_dir, "part").filter("p_partkey % 100 = 7").select(k.alias("id"), (-k).alias("place"))
    out = None
    for mode in ("priority", "name", "date"):
        for descending in (False, True):
            part = catalog.sorted_layers(catalog_, mode, order, descending).limit(10).select(F.lit(mode).alias("mode"), F.lit(descending).alias("descending"), "id")
            out = part if out is None else out.unionByName(part)
    return out


def newest_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest entries by their date and time as text, oldest of them last."""
    entries = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.date_format("ts", "HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("time"))
    return catalog.latest_texts(entries, "date", "time").limit(50).select("event_id")


def natural_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of numbers of up to 20 digits, with accents before them: each has more digits than a fixed width would keep."""
    k = F.col("s_suppkey")
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(k % 2 == 0, "É").otherwise("e"), F.lit("00"), F.lit("9" * 15), (k % 7 + 1).cast("string"), F.lpad(k.cast("string"), 6, "0")).alias("name"))
    keyed = names.withColumn("sort_key", catalog.natural_key(F.col("name")))
    return keyed.select("s_suppkey", F.rank().over(Window.orderBy("sort_key")).cast("long").alias("place"))


def print_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("date"), F.format_string("%.2f", F.col("l_quantity").cast("double")).alias("total_water"), "l_returnflag")
    return reports.print_statistics(entries, ["l_returnflag"])


def last_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_points(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"], 50).select("event_id")


def composite_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of the agriculture composite's bands and of scaled NDVI and SAVI for each scene class."""
    scaled = indices.bands(indices.REFLECTANCE_SCALE)
    found = raster.composite(pixels(spark, sf_dir), "agriculture")
    return found.groupBy("SCL").agg(*[js.quantised(F.avg(c), 4).alias(c) for c in ("red", "green", "blue")], *[js.quantised(F.avg(indices.index(n, scaled)), 6).alias(n.lower()) for n in ("NDVI", "SAVI")])


def class_dashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = [(k, i, d, w) for k in (2, 5, 12) for i, (d, w) in enumerate(zip(geo.class_dashes(k), geo.class_widths(len(geo.class_dashes(k))), strict=True))]
    made = spark.createDataFrame(styles, "classes int, class int, dashes string, width double")
    return made.withColumn("zoom", F.lit(geo.initial_zoom())).withColumn("width", js.quantised(F.col("width"), 4))


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.local_minutes(F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 61_000), "Asia/Riyadh").alias("local"), text.filled_time(F.when(F.col("event_id") % 2 == 0, "07:15"), F.col("ts")).alias("time"))


def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [(n, t, layers.guessed_kind(s, t)) for n, t in table(spark, sf_dir, "lineitem").dtypes for s in ((None, "esriFieldTypeDate") if n == "l_comment" else (None,))]
    return spark.createDataFrame(made, "field string, type string, kind string").select("field", "kind")


def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and counts of lists."""
    k = F.col("s_suppkey")
    catalog_ = table(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, "Point").otherwise("Polygon").alias("geometry_type"))
    searched = lists.counted(lists.search_layers(catalog_, " POINT "), F.lit(True), "rows")
    issues = lists.counted(lists.issues_only(table(spark, sf_dir, "supplier").select(k, F.when(k % 3 == 0, "url").alias("pull_request"))), F.lit(True), "rows")
    accounts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.col("c_custkey").alias("seq"))
    names = lists.counted(catalog.first_nonblank(accounts, ["nation"], "name", "seq"), F.lit(True), "rows")
    return searched.withColumn("list", F.lit("layers")).unionByName(issues.withColumn("list", F.lit("issues"))).unionByName(names.withColumn("list", F.lit("accounts")))


def tree_of_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("layer"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("target"), F.lit("one_to_many").alias("kind"))
    found = relate.tree(relations)
    return found.select("layer", F.array_join(F.transform("relations", lambda r: F.concat(r["name"], F.lit(":"), r["target"])), ",").alias("names"))


def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).filter("c_custkey % 6 = 0")
    return relate.selected(table(spark, sf_dir, "customer"), keys, "c_custkey").select("c_custkey")


QUERIES = {
    f.__name__: f
    for f in (
        ec_entries, ec_submit, first_errors, form_bindings, farm_attributes, farm_best_option, farm_short_terms, audit_log, location_forms, shown_layers, merge_repeated, replace_by_nothing, decode_repeated, record_pages,
        layers_by_mode, newest_by_text, natural_long, print_report, last_50, composite_bands, class_dashes, local_times, value_kinds, list_counts, tree_of_relations, selected_rows,
    )
}
_LAYERS = "SELECT p_partkey AS id, 'L' || (p_partkey % 50) AS name, p_partkey % 50 AS n, '2024-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS created_at, CASE WHEN p_partkey % 100 = 7 THEN -p_partkey ELSE 9007199254740991 END AS place FROM part"
_MODES = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, {str(down).lower()} AS descending, id FROM (SELECT * FROM l ORDER BY {key} {way}, id {way} LIMIT 10)"
    for mode, key in (("priority", "place"), ("name", "n"), ("date", "created_at"))
    for down, way in ((False, "ASC"), (True, "DESC"))
)
ORACLES = {
    "ec_entries": """WITH b AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS broken, concat_ws('; ', CASE WHEN o_orderkey % 3 = 2 THEN 'kind must be draft or submitted' END, CASE WHEN o_orderkey % 5 = 0 THEN 'state.selectedFieldsBySource is required' END) AS problems FROM orders)
        SELECT k AS o_orderkey, CASE WHEN broken OR problems <> '' THEN 'rejected' ELSE 'accepted' END AS status,
            CASE WHEN broken THEN 'formKey is required; kind is required; state.sourceIds is required; state.selectedFieldsBySource is required; state.valuesBySource is required' WHEN problems <> '' THEN problems ELSE 's1' END AS detail FROM b""",
    "ec_submit": """SELECT l_linenumber, concat_ws('; ', CASE WHEN l_linenumber = 4 THEN 'Site' END,
            CASE WHEN l_linenumber = 1 THEN 'pH_In must be a number' WHEN round(l_quantity / 2, 1) > 14 THEN 'pH_In must be ≤ 14' END,
            CASE l_linenumber WHEN 2 THEN 'Cycle must be an integer' WHEN 3 THEN 'Cycle must be ≥ 1' END) AS errors, count(*) AS forms FROM lineitem GROUP BY ALL""",
    "first_errors": """SELECT p_partkey, least(p_size, 12)::INT AS errors, array_to_string(list_transform(range(least(p_size, 12)), lambda i: 'error ' || i), ',') AS shown FROM part""",
    "form_bindings": """SELECT n_name AS form_key, CASE WHEN n_nationkey < 10 THEN 'layer ' || n_nationkey END AS management_layer, CASE WHEN n_nationkey >= 5 THEN 's1' END AS sources,
        CASE WHEN n_nationkey >= 5 THEN n_name END AS field, CASE WHEN n_nationkey >= 5 THEN n_nationkey % 2 = 0 END AS required FROM nation""",
    "farm_attributes": """WITH f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 0 THEN printf('%.6f', s_suppkey / 20.0::DOUBLE) END AS lat, CASE WHEN s_suppkey % 5 <> 0 THEN printf('%.6f', s_suppkey / 10.0::DOUBLE) END AS lon,
            CASE WHEN s_suppkey % 2 = 0 THEN strftime(DATE '1970-01-01' + s_suppkey::INT, '%Y-%m-%d') WHEN s_suppkey % 3 = 0 THEN '2024-05-06' END AS edited FROM supplier)
        SELECT k AS s_suppkey, field, value FROM (SELECT k, unnest(['Farm_Code', 'ProjectCode', 'Country', 'Own', 'Location', 'LAT', 'edit_date']) AS field, unnest(['F' || k, 'P', '', 'kept', lat || ', ' || lon, lat, edited]) AS value FROM f) WHERE value IS NOT NULL""",
    "farm_best_option": """WITH o AS (SELECT s_nationkey::VARCHAR AS term, s_suppkey::VARCHAR AS code, s_suppkey AS seq FROM supplier),
        s AS (SELECT *, CASE WHEN code = term THEN 1000 WHEN starts_with(code, term) THEN 900 WHEN contains(code, term) THEN 800 ELSE 0 END AS score FROM o)
        SELECT term, code, score FROM s QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, seq) = 1""",
    "farm_short_terms": """WITH t AS (SELECT DISTINCT unnest([n_nationkey, n_nationkey + 990, n_nationkey * 101 + 1000])::VARCHAR AS term FROM nation), c AS (SELECT c_custkey::VARCHAR AS code FROM customer)
        SELECT term, code, CASE WHEN code = term THEN 1000 WHEN starts_with(code, term) THEN 900 ELSE 800 END AS score FROM t JOIN c ON contains(code, term)
        QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, length(code), code) = 1""",
    "audit_log": """SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, 'user' AS entity, event_type AS action, CASE WHEN event_id % 2 <> 0 THEN user_id::VARCHAR END AS entity_id, 'a@x' AS actor_email
        FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0""",
    "location_forms": "SELECT o_orderkey AS form_id, 'read' AS permissions, o_orderpriority AS created_at FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'",
    "shown_layers": "SELECT p_partkey AS id, 'legend' AS kind FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'map' FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_name IS NOT NULL",
    "merge_repeated": """SELECT c_custkey, coalesce((SELECT arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0), c_name) AS c_name,
        coalesce((SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 <> 0), c_mktsegment) AS c_mktsegment FROM customer""",
    "replace_by_nothing": """SELECT o_custkey AS geo_id, o_orderkey AS form_id FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 2 = 0 UNION ALL
        SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 2 = 0)""",
    "decode_repeated": """WITH d AS (SELECT n_nationkey, coalesce(min(c_mktsegment), n_nationkey::VARCHAR) AS name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)
        SELECT n_nationkey, name AS n_nationkey_name, coalesce((SELECT min(c_nationkey::VARCHAR) FROM customer WHERE c_mktsegment = name), name) AS back FROM d""",
    "record_pages": "WITH t AS (SELECT count(*) AS n, greatest(1, ceil(count(*) / 200.0))::BIGINT AS pages FROM customer) SELECT c_custkey, pages FROM customer, t QUALIFY row_number() OVER (ORDER BY c_custkey) > (pages - 1) * 200",
    "layers_by_mode": f"WITH l AS ({_LAYERS}) {_MODES}",
    "newest_by_text": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "natural_long": "SELECT s_suppkey, rank() OVER (ORDER BY ('999999999999999' || (s_suppkey % 7 + 1) || lpad(s_suppkey::VARCHAR, 6, '0'))::HUGEINT) AS place FROM supplier",
    "print_report": "SELECT l_returnflag, count(*) AS entries, printf('%.2f', sum(round(l_quantity, 2))) AS water, strftime(min(l_shipdate), '%Y-%m-%d') AS first_date, strftime(max(l_shipdate), '%Y-%m-%d') AS last_date FROM lineitem GROUP BY 1",
    "last_50": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "composite_bands": """SELECT l_linenumber AS SCL, floor(avg(l_suppkey::DOUBLE) * 1e4 + 0.5) / 1e4 AS red, floor(avg(l_extendedprice::DOUBLE) * 1e4 + 0.5) / 1e4 AS green, floor(avg(l_linenumber::DOUBLE) * 1e4 + 0.5) / 1e4 AS blue,
        floor(avg((l_extendedprice::DOUBLE / 1e4 - l_quantity::DOUBLE / 1e4) / (l_extendedprice::DOUBLE / 1e4 + l_quantity::DOUBLE / 1e4)) * 1e6 + 0.5) / 1e6 AS ndvi,
        floor(avg((l_extendedprice::DOUBLE / 1e4 - l_quantity::DOUBLE / 1e4) / (l_extendedprice::DOUBLE / 1e4 + l_quantity::DOUBLE / 1e4 + 0.5::DOUBLE) * 1.5::DOUBLE) * 1e6 + 0.5) / 1e6 AS savi FROM lineitem GROUP BY 1""",
    "class_dashes": """SELECT k::INT AS classes, (i - 1)::INT AS class, ['1 10', '1 7', '1 5', '1 3.5', '1 2.5', '1 2', '1 1.6', '1 1.3', '1 1.1'][i] AS dashes, floor((1.5::DOUBLE + 4.5::DOUBLE * (i - 1) / (n - 1)) * 1e4 + 0.5) / 1e4 AS width,
        round(log2(156543.03392804097::DOUBLE * cos(radians(20.0::DOUBLE)) / (1e8::DOUBLE / (96 * 39.37::DOUBLE))), 1) AS zoom FROM (SELECT unnest([2, 5, 12]) AS k, unnest([3, 5, 9]) AS n), generate_series(1, 9) AS g(i) WHERE i <= n""",
    "local_times": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(TIMESTAMP '1970-01-01 03:00:00' + to_seconds(event_id * 61), '%Y-%m-%dT%H:%M') ELSE '' END AS local, CASE WHEN event_id % 2 = 0 THEN '07:15' ELSE strftime(ts, '%H:%M') END AS time FROM events",
    "value_kinds": "SELECT column_name AS field, CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') OR column_type LIKE 'DECIMAL%' THEN 'number' ELSE 'text' END AS kind FROM (DESCRIBE lineitem)",
    "list_counts": """SELECT 'layers' AS list, count(*) AS rows FROM supplier WHERE s_suppkey % 2 = 0 OR contains(lower(s_name), 'point') UNION ALL SELECT 'issues', count(*) FROM supplier WHERE s_suppkey % 3 <> 0
        UNION ALL SELECT 'accounts', count(DISTINCT c_nationkey) FROM customer WHERE c_custkey % 2 <> 0""",
    "tree_of_relations": "SELECT n_regionkey AS layer, string_agg(n_name || ':' || n_nationkey, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    "selected_rows": "SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
}
