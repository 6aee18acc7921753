"""Forms, saved layers, signatures, breaks and quantiles beside plain versions of them."""

import hmac
import json
import struct
import zipfile
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conftest import DATA

from furrow import session
from furrow.functions import geo, js, text
from furrow.operators import catalog, forms, layers, lists, quantiles, raster, relate, schema
from furrow.sources import arcgis, files, stores


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_signature_is_hmac(spark):
    bodies = ["", "x", '{"a": "é"}', "y" * 500]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    for secret in ("k", "s" * 64, "long " * 30):
        wanted = {b: "sha256=" + hmac.new(secret.encode(), b.encode(), sha256).hexdigest() for b in bodies}
        assert {r.body: r.s for r in frame.select("body", text.signature(secret, F.col("body")).alias("s")).collect()} == wanted
    holds = text.signature_holds("k")
    assert one(spark, holds(F.lit("x"), F.lit("sha256=" + hmac.new(b"k", b"x", sha256).hexdigest())), holds(F.lit("x"), F.lit(None).cast("string"))) == [True, False]


def cost(x, cuts):
    edges = [0, *cuts, len(x)]
    return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:], strict=False))


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_natural_breaks_beside_all_cuts(classes):
    rng = np.random.default_rng(4)
    for _ in range(30):
        x = np.sort(rng.integers(0, 40, 11).astype(float))
        distinct, weights = np.unique(x, return_counts=True)
        if len(distinct) < classes:
            continue
        best = min(cost(x, cuts) for cuts in combinations(range(1, len(x)), classes - 1))
        limits = layers.natural_breaks(distinct, classes, weights)
        cuts = [int(np.searchsorted(x, limit)) for limit in limits[1:-1]]
        assert cost(x, cuts) == pytest.approx(best, abs=1e-6) and limits[0] == x[0] and limits[-1] == x[-1]


def test_natural_breaks_known():
    values = np.array([1, 2, 3, 10, 11, 12, 50, 51])
    assert layers.natural_breaks(values, 3) == [1, 10, 50, 51] and layers.natural_breaks(values, 5) == [1, 2, 10, 11, 50, 51]
    assert layers.natural_breaks(np.array([1, 2, 5, 9, 20]), 5) == [1, 2, 5, 9, 20, 20] and layers.natural_breaks(np.array([]), 3) == []


def test_breaks_take_all_values(spark):
    """Beyond any sample: the gap lies after 6,000 rows, and again with more values than a task may hold."""
    rows = spark.range(8000).select(F.lit("g").alias("g"), F.col("id").alias("seq"), (F.col("id") % 100 + F.when(F.col("id") >= 6000, 10_000).otherwise(0)).cast("double").alias("x"))
    assert layers.natural_breaks_by(rows, ["g"], "x", 2).first()["breaks"] == [0.0, 10_000.0, 10_099.0]
    assert layers.natural_breaks_by(rows, ["g"], "x", 2, sample=5000).first()["breaks"][-1] == 99.0
    assert layers.natural_breaks_by(rows, ["g"], "x", 2, cells=16).first()["breaks"][1] == 10_000.0


@pytest.mark.parametrize("cells", [64, layers.CELLS])
def test_breaks_of_many_values_are_those_of_all_at_once(spark, cells):
    """200,000 different values in groups of several shapes, null and small groups, beside the function that holds all."""
    rng = np.random.default_rng(8)
    few = 1_500 if cells < 100 else 50_000
    groups = {
        "normal": rng.normal(size=few), "long tail": rng.pareto(1.5, size=few), "bumps": np.concatenate([rng.normal(m, 0.4, few // 4) for m in (0, 3, 4, 20)]), "squares": (np.arange(few) / 7.0) ** 2,
        "one": np.array([5.0] * 9), "two": np.array([1.0, 1.0, 2.0]), "three": np.array([3.0, 1.0, 2.0]), None: rng.integers(0, 50, 4_000).astype(float),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None), ("one", float("nan")), ("two", float("inf"))]
    df = spark.createDataFrame(__import__("pandas").DataFrame(rows, columns=["g", "x"]), "g string, x double").repartition(4)
    for classes in (4,) if cells < 100 else (6,):
        found = {r.g: r.breaks for r in layers.natural_breaks_by(df, ["g"], "x", classes, cells=cells).collect()}
        assert found == {g: pytest.approx(layers.natural_breaks(*np.unique(x, return_counts=True)[:1], classes, np.unique(x, return_counts=True)[1])) for g, x in groups.items()}


def test_breaks_without_groups_or_rows(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("x"))
    assert layers.natural_breaks_by(df, [], "x", 4, cells=8).first()["breaks"] == layers.natural_breaks(np.arange(1000) ** 2, 4)
    assert layers.natural_breaks_by(df.limit(0), [], "x", 4).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    for values in (rng.integers(0, 30, 501).astype(float), rng.normal(size=1000), np.array([4.0]), np.array([1.0, 2.0])):
        frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        shares = [0.0, 0.1, 0.5, 0.77, 1.0]
        assert quantiles.exact_quantiles(frame, "x", shares).first()["quantiles"] == pytest.approx(list(np.quantile(values, shares)))
    assert quantiles.exact_quantiles(frame.limit(0), "x", [0.5]).first()["quantiles"] == [None]


def test_natural_key_has_no_width(spark):
    names = ["V1234567890124", "V1234567890123", "v99", "V007", "é2", "E10", "e1", "x" + "9" * 40, "x1" + "0" * 40]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in frame.orderBy(catalog.natural_key(F.col("name"))).collect()] == ["e1", "é2", "E10", "V007", "v99", "V1234567890123", "V1234567890124", "x" + "9" * 40, "x1" + "0" * 40]


def test_lookup_of_short_terms(spark):
    farms = spark.createDataFrame([("ABX",), ("ZF1",), ("FAR-001",), ("FAR-0012",)], "code string")
    asked = spark.createDataFrame([("AB",), ("F1",), ("b",), ("far001",), ("r0012",), ("QQ",), ("-",)], "term string")
    found = {r.term: (r.code, r.score) for r in relate.lookup_by_code(asked, farms, "term", "code", scored=True).collect()}
    assert found == {"AB": ("ABX", 900), "F1": ("ZF1", 800), "b": ("ABX", 800), "far001": ("FAR-001", 1000), "r0012": ("FAR-0012", 800)}


def test_best_option_may_score_nothing(spark):
    asked = spark.createDataFrame([("ZZ",), ("F2",)], "term string")
    options = spark.createDataFrame([("ZZ", "F1", 1), ("ZZ", "F9", 2), ("F2", "F22", 2), ("F2", "F2", 3), ("F2", " ", 1)], "term string, code string, seq int")
    assert {r.term: (r.code, r.score) for r in relate.best_option(asked, options, "term", "code", "seq").collect()} == {"ZZ": ("F1", 0), "F2": ("F2", 1000)}


def test_key_transforms(spark):
    keys = [relate.key_transform(F.lit(" Ab "), t) for t in ("none", "trim", "lower", "upper")] + [relate.key_transform(F.lit(v), "number") for v in ("07", "1.5", "1e999", "x")]
    assert one(spark, *keys) == [" Ab ", "Ab", " ab ", " AB ", "7", "1.5", None, None]


def test_submit_errors(spark):
    values = F.create_map(F.lit("a"), F.create_map(F.lit("pH_In"), F.lit("15"), F.lit("Cycle"), F.lit("0.5"), F.lit("N"), F.lit(" ")), F.lit("b"), F.create_map(F.lit("pH_In"), F.lit("x")))
    field = lambda n, e, r: F.struct(F.lit(n).alias("name"), F.lit(e).alias("enabled"), F.lit(r).alias("required"))
    configs = F.create_map(F.lit("a"), F.array(field("N", True, True), field("Off", False, True)), F.lit("c"), F.array(field("Lost", True, True)))
    assert one(spark, forms.submit_errors(values, configs)) == [["N", "Lost", "pH_In must be ≤ 14", "Cycle must be an integer"]]


def test_farm_updates_can_be_cleared(spark):
    enabled = F.array(F.lit("Farm_Code"), F.lit("Country"), F.lit("Other"))
    assert one(spark, forms.cleared(enabled, forms.FARM_FIELDS)) == [{"Farm_Code": "", "Country": ""}]
    assert one(spark, forms.farm_attributes(F.create_map(F.lit("edit_date"), F.lit("0"))))[0]["LAST_UPDATE"] == "1970-01-01"


def test_saved_layers(spark, tmp_path):
    assert stores.load_layers(spark, f"{tmp_path}/layers").count() == 0
    for names in (["a"], ["a", "b"]):
        rows = [(n, n, "geojson", True, "2024", ["f"], [("Point", [[1.0, 2.0]], {"f": "v"})]) for n in names]
        stores.save_layers(spark.createDataFrame(rows, stores.LAYERS), f"{tmp_path}/layers")
    assert sorted(r.id for r in stores.load_layers(spark, f"{tmp_path}/layers").collect()) == ["a", "b"]
    (tmp_path / "layers" / "version=9").mkdir()  # one that wasn't written to its end doesn't count
    assert stores.load_layers(spark, f"{tmp_path}/layers").count() == 2
    log = spark.createDataFrame([(i, "x") for i in range(10)], "at int, form string")
    stores.append_capped(log, spark.createDataFrame([(10, "x")], log.schema), 4, ["at"], f"{tmp_path}/log")
    assert sorted(r[0] for r in stores.load_layers(spark, f"{tmp_path}/log", "at int, form string").collect()) == [7, 8, 9, 10]


def test_catalogs_fall_back(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, name string")
    found = files.with_fallback(frame(("a", "1")), frame(("a", "2"), ("b", "2")), frame(("b", "3"), ("c", "3")))
    assert sorted(map(tuple, found.collect())) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_feature_service_needs_no_page_count(spark, tmp_path):
    features = [{"attributes": {"n": v}, "geometry": {"x": v, "y": 0}} for v in range(4500)]
    (tmp_path / "f.json").write_text(json.dumps({"features": features}))
    spark.dataSource.register(arcgis.ArcGisSource)
    found = spark.read.format("arcgis").options(path=f"{tmp_path}/f.json").load()
    assert found.rdd.getNumPartitions() == 3 and found.select("x").distinct().count() == found.count() == 4500
    with pytest.raises(Exception, match="more than the 2 allowed"):
        spark.read.format("arcgis").options(path=f"{tmp_path}/f.json", pages=2).load().count()


def test_short_pages_are_asked_again(monkeypatch):
    monkeypatch.setattr(arcgis, "_count", lambda path: 5)
    monkeypatch.setattr(arcgis, "_from_file", lambda path: lambda offset, limit: [{"attributes": {"n": n}} for n in range(offset, min(6, offset + min(limit, 2)))])
    reader = arcgis._Recorded({"path": "x", "page": "3"}, StructType())
    rows = [json.loads(r[0])["n"] for p in reader.partitions() for r in reader.read(p)]
    assert rows == [0, 1, 2, 3, 4, 5]  # a service that gives two at a time, and one feature more than it said


def test_renderer_of_a_definition(spark, tmp_path):
    infos = [{"value": "a", "label": "A", "symbol": {"color": [1, 2, 3, 255]}}, {"value": "b", "label": "B", "symbol": None}]
    (tmp_path / "d.json").write_text(json.dumps({"drawingInfo": {"renderer": {"type": "uniqueValue", "field1": "k", "uniqueValueInfos": infos}}}))
    found = arcgis.renderer_infos(arcgis.layer_definition(spark, f"{tmp_path}/d.json")).orderBy("place").collect()
    assert [(r.label, r.value) for r in found] == [("A", "a"), ("B", "b")] and found[0].symbol.color == [1.0, 2.0, 3.0, 255.0]


def test_json_exports(spark, tmp_path):
    frame = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    files.write_json(frame, f"{tmp_path}/out")
    assert sorted(spark.read.schema("a int, b string").json(f"{tmp_path}/out").collect(), key=lambda r: r.a) == sorted(frame.collect(), key=lambda r: r.a)
    made = files.pretty_json(frame, ["a"]).first()["json"]
    assert json.loads(made) == [{"a": 1, "b": "x"}, {"a": 2, "b": None}] and "\n" in made
    with pytest.raises(ValueError):
        files.pretty_json(spark.range(files.MAX_EXPORT + 1), ["id"])


def test_shapes_with_heights(spark, tmp_path):
    def archive(body):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("x.shp", struct.pack(">i", 9994) + bytes(96) + struct.pack(">2i", 1, len(body) // 2) + body)
        return str(path)

    found = files.read_layer(spark, archive(struct.pack("<i4d", 11, 7.0, 8.0, 9.0, 0.0))).first()
    assert (found.geometry_type, found.coordinates) == ("Point", [[7.0, 8.0]])
    with pytest.raises(Exception, match="shape type 31"):
        files.read_layer(spark, archive(struct.pack("<i2d", 31, 7.0, 8.0))).collect()


def test_scenes_of_a_client(spark):
    rows = [("s1", "a", "2024-01-02 23:59:59", 5.0), ("s2", "a", "2024-01-03 00:00:00", 5.0), ("s3", "b", "2024-01-02 01:00:00", 5.0), ("s4", "a", "2024-01-01 00:00:00", 20.0), ("s5", "a", "2024-01-01 00:00:00", 1.0)]
    scenes = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0) for r in rows], "scene_id string, collection string, datetime string, cloud_cover double, west double, south double, east double, north double")
    search = lambda **area: [r.scene_id for r in raster.client_search(scenes, "a", "2024-01-01", "2024-01-02", 20.0, **area).collect()]
    assert search(view=(0, 0, 2, 2)) == ["s1", "s5"] and search(view=(0, 0, 2, 2), area=(5, 5, 6, 6)) == []
    with pytest.raises(ValueError):
        search()
    assert [r.scene_id for r in raster.search_scenes(scenes, "2024-01-01", "2024-01-03 00:00:00", closed=False).orderBy("scene_id").collect()] == ["s1", "s3", "s5"]


def test_small_functions(spark):
    assert one(spark, js.lerp(1.0, 3.0, F.lit(0.25)), text.without_bold(F.lit("**a** b")), text.display_text(F.lit(None).cast("string"), "string"), text.wants_detail(F.lit("Tell me MORE"))) == [1.5, "a b", "", True]
    assert one(spark, text.service_url(F.lit(" http://h/a//?x#y ")), geo.geometry_kind(F.lit("MultiPolygon")), raster.clamp_date(F.lit("2024-05-05"), F.lit("2024-01-01"), F.lit("2024-02-02"))) == ["http://h/a", "polygon", "2024-02-02"]
    point = one(spark, geo.point_feature(F.lit(1.0), F.lit(2.0), F.create_map(F.lit("k"), F.lit("v"))))[0]
    assert point["geometry"]["coordinates"] == [1.0, 2.0] and point["properties"] == {"k": "v"}
    assert one(spark, text.mask_map(F.create_map(F.lit("apiKey"), F.lit("1"), F.lit("n"), F.lit("2")))) == [{"apiKey": "***", "n": "2"}]
    assert one(spark, text.display_text(F.create_map(F.lit("a"), F.lit(1)), "map<string,int>")) == ['{"a":1}']
    assert layers.Symbology("unique").normalised().classes == 12 and layers.Symbology(classes=40).normalised().classes == 12 and layers.Symbology().normalised().classes == 5
    assert (layers.guessed_kind("esriFieldTypeDate", "string"), layers.guessed_kind(None, "double"), layers.guessed_kind("esriFieldTypeString", "string")) == ("date", "number", "text")
    assert (geo.initial_zoom(), geo.class_dashes(1)) == (2.5, ["1 10", "1 7", "1 5"])


def test_columns_of_relations_stay(spark):
    frame = spark.createDataFrame([(1, 2)], "a int, b int")
    assert schema.drop_field(frame, "b", ["a"]).columns == ["a"]
    with pytest.raises(ValueError):
        schema.drop_field(frame, "a", ["a"])


def test_validators(spark):
    from furrow.functions import records

    assert one(spark, *[records.valid_email(F.lit(v)) for v in ("a@b.c", "a b@c.d", "a@b")]) == [True, False, False]
    ordered = catalog.order_missing_last(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("c", 1), ("b", 2)], "id string, place int"), "id")
    assert [r.id for r in ordered.collect()] == ["c", "b", "a"]
    assert lists.counted(ordered, F.col("id") > "a").first()["count"] == 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(**values)

    with pytest.raises(RuntimeError):
        session.shared_folder(Session(**{"spark.master": "spark://host:7077"}))
    assert session.shared_folder(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///work/"})) == "hdfs:///work"
    assert session.shared_folder(Session(**{"spark.master": "local[2]"})).startswith("file:///")


def test_equal_forms_are_checked_once(spark):
    from furrow.plans import registry

    plan = registry.QUERIES["ec_submit"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    counts = [line for line in plan.splitlines() if "Aggregate" in line]
    assert len(counts) == 2 and "Aggregate [l_linenumber" in counts[1] and "l_quantity" in counts[1].split("]")[0]
