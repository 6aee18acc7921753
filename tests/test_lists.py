"""Lists, stored tables and messages."""

from pyspark.sql import functions as F

from furrow.functions import text
from furrow.operators import lists, locations, schema, styling
from furrow.sources import stores

FARMS = [("F-1001", "North Farm", "Tomato", "12.5", "2026-01-11", "Active"), ("F-1002", "South Farm", "Wheat", "54.2", "2025-11-04", "Active")]


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_external_tables(spark):
    farms = stores.external_table(spark, "Location_Master", FARMS)
    assert farms.dtypes[3:5] == [("area_ha", "double"), ("planted_on", "date")]
    assert spark.table("location_master").filter("area_ha > 20").count() == 1
    bad = spark.createDataFrame([("x", "", "Rice", "much", "", "Active")], ", ".join(f"{c} string" for c in farms.columns))
    assert bad.select(stores.row_errors(stores.LOCATION_MASTER)).first()[0] == ["farm_name is required", "crop_type is not allowed", "area_ha is no double"]


def test_entries_and_settings(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"id": "1", "n": 2}, {"id": "2"}]')
    (tmp_path / "bad.json").write_text('{"id": "1"}')
    read = lambda n: sorted(map(tuple, stores.read_entries(spark, f"{tmp_path}/{n}", "id string, n int").collect()))
    assert (read("good.json"), read("bad.json"), read("missing.json")) == ([("1", 2), ("2", None)], [], [])
    fallback = F.array(F.lit("x"))
    assert one(spark, stores.setting(F.lit('["a"]'), "array<string>", fallback), stores.setting(F.lit("oops"), "array<string>", fallback)) == [["a"], ["x"]]


def test_layer_lists(spark):
    layers = spark.createDataFrame([("arcgis:1", "North"), ("geojson:2", "South"), ("own", "Northern")], "id string, name string")
    selected = spark.createDataFrame([("own",), ("geojson:2",)], "id string")
    assert {r.id for r in lists.filter_layers(layers, " NORTH ").collect()} == {"arcgis:1", "own"}
    assert {r.id for r in lists.filter_layers(layers, group="custom").collect()} == {"own"}
    assert {r.id for r in lists.filter_layers(layers, "south", selected=selected).collect()} == {"geojson:2"}
    assert [tuple(r) for r in lists.grouped_layers(layers).collect()] == [("arcgis", ["arcgis:1"]), ("custom", ["own"]), ("geojson", ["geojson:2"])]
    assert {r.id for r in lists.toggled(selected, layers, True).collect()} == {"arcgis:1", "geojson:2", "own"}
    assert lists.toggled(selected, layers, False).count() == 0


def test_people_and_answers(spark):
    users = spark.createDataFrame([("Ann", "a@x", "Admin", "Active"), ("Bob", "b@x", "Editor", "Inactive")], "name string, email string, role string, status string")
    assert [r.name for r in lists.filter_users(users, "X", status="Inactive").collect()] == ["Bob"]
    log = spark.createDataFrame([("user", "A@x"), ("user", "b@x"), ("layer", "a@x")], "entity string, actor_email string")
    assert [lists.audit_visible(log, "a@x", r).count() for r in ("Manager", "Admin Manager", "Viewer")] == [2, 1, 0]
    answers = spark.createDataFrame([("satisfied",), ("neutral",), ("very_satisfied",)], "satisfaction string")
    assert lists.satisfaction(answers).first()[0] == 67 and lists.satisfaction(answers.limit(0)).first()[0] == 0
    assert one(spark, lists.completion(F.create_map(F.lit("a"), F.lit(True), F.lit("b"), F.lit(False)))) == [50]
    assert [r.satisfaction for r in lists.sorted_by(answers, "satisfaction").collect()] == ["neutral", "satisfied", "very_satisfied"]


def test_messages(spark):
    weather, plain = one(spark, text.with_context(F.lit("Rain and pests?")), text.with_context(F.lit("hello")))
    assert "Mock Weather" in weather and weather.startswith("Rain and pests?\n\nCONTEXT_DATA") and plain == "hello"
    assert one(spark, text.guessed_plant(F.lit("my Palm")), text.guessed_plant(F.lit("rose"))) == ["Date Palm", "Unidentified"]


def test_schema_rules(spark):
    assert schema.field_problem("1a", []) and schema.field_problem("A", ["a"]) == "Field name already exists." and schema.field_problem("a", [], "text", "0")
    assert schema.field_problem(" good_1 ", ["other"], "text", "12") is None
    assert one(spark, schema.normal_role(F.lit("super admin-manager")), schema.allowed("dataSource.update", F.lit("editor"))) == ["Admin Manager", False]


def test_renderers(spark):
    assert one(spark, styling.dash_array(F.lit("esriSLSDot"), 2), styling.dash_array(F.lit("esriSLSSolid"), 2)) == ["2 5", None]
    colour = styling.colour_and_opacity(F.array(*[F.lit(v) for v in (255.0, 0.0, 300.0, 51.0)]))
    assert tuple(one(spark, colour)[0]) == ("#ff00ff", 0.2)


def test_location_rules(spark):
    rings = "array<array<array<double>>>"
    kind = f"geo_id int, seq int, ts string, country string, site string, project string, project_id string, zone_id string, code_id string, date string, wkt string, geometry_type string, rings {rings}, forms array<struct<id:string,permissions:array<string>>>"
    row = lambda i, site, ring=1: (i, i, "t", "SA", site, "p", "", "abc", "abcd1234", "d", "w", "Point", [[[0.0, 0.0]] * ring], [("f", ["read"])])
    new = spark.createDataFrame([row(1, "A"), row(2, " a "), row(3, "B", 1001), row(4, "old")], kind)
    made = locations.insert(spark.createDataFrame([("OLD",)], "site string"), new)
    assert [r.geo_id for r in made.locations.collect()] == [1] and made.attributes.count() == 7 and made.links.count() == 1
    assert {r.geo_id: r.errors for r in made.rejected.collect()} == {2: ["site must be unique"], 3: ["more than 1000 vertices"], 4: ["site must be unique"]}
