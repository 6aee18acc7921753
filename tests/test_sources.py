"""Files that the tests write themselves."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from furrow.sources import arcgis, files

KML = """<?xml version="1.0"?><kml><Document><Placemark><name>A</name><ExtendedData><Data name="k"><value>v</value></Data></ExtendedData><Point><coordinates>1,2,0</coordinates></Point></Placemark>
<Placemark><name>B</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""


def ordered(features):
    return sorted(features, key=lambda f: json.dumps(f, sort_keys=True))


def rows(df):
    return ordered((dict(r.props), r.geometry_type, r.coordinates) for r in df.collect())


def test_csv_points_and_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text('name,Lat,LNG\n"a, b",1.5,2\nbad,x,2\n\nc,3,4\n')
    assert rows(files.read_layer(spark, f"{tmp_path}/p.csv")) == [({"name": "a, b"}, "Point", [[2.0, 1.5]]), ({"name": "c"}, "Point", [[4.0, 3.0]])]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert files.read_layer(spark, f"{tmp_path}/t.csv").dtypes == [("a", "int"), ("b", "string")]


def test_geojson(spark, tmp_path):
    shapes = [("Point", [1, 2], [[1.0, 2.0]]), ("LineString", [[0, 0], [1, 1]], [[0.0, 0.0], [1.0, 1.0]]), ("Polygon", [[[0, 0], [1, 0], [0, 0]]], [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]])]
    features = [{"type": "Feature", "properties": {"n": k}, "geometry": {"type": k, "coordinates": c}} for k, c, _ in shapes]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    assert rows(files.read_layer(spark, f"{tmp_path}/f.geojson")) == ordered(({"n": k}, k, p) for k, _, p in shapes)


def test_kml_and_kmz(spark, tmp_path):
    expected = [({"name": "A", "k": "v"}, "Point", [[1.0, 2.0]]), ({"name": "B"}, "Polygon", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]])]
    (tmp_path / "f.kml").write_text(KML)
    assert rows(files.read_layer(spark, f"{tmp_path}/f.kml")) == ordered(expected)
    with zipfile.ZipFile(tmp_path / "f.kmz", "w") as z:
        z.writestr("doc.kml", KML)
    assert [(p["name"], k, c) for p, k, c in rows(files.read_layer(spark, f"{tmp_path}/f.kmz"))] == [("A", "Point", [[1.0, 2.0]]), ("B", "Polygon", expected[1][2])]


def test_gpx(spark, tmp_path):
    (tmp_path / "f.gpx").write_text('<gpx><wpt lat="1" lon="2"><name>w</name></wpt><trk><trkseg><trkpt lat="3" lon="4"><ele>5</ele></trkpt></trkseg></trk></gpx>')
    assert rows(files.read_layer(spark, f"{tmp_path}/f.gpx")) == ordered([({"tag": "trkpt", "ele": "5"}, "Point", [[4.0, 3.0]]), ({"tag": "wpt", "name": "w"}, "Point", [[2.0, 1.0]])])


def test_shapefile(spark, tmp_path):
    body = struct.pack("<i2d", 1, 7.0, 8.0)
    shp = struct.pack(">i", 9994) + bytes(96) + struct.pack(">2i", 1, len(body) // 2) + body
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15)
    dbf = bytes(4) + struct.pack("<IHH", 1, 32 + 32 + 1, 6) + bytes(20) + field + b"\r" + b" " + b"well "
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x.shp", shp)
        z.writestr("x.dbf", dbf)
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    assert rows(files.read_layer(spark, f"{tmp_path}/x.zip")) == [({"NAME": "well"}, "Point", [[7.0, 8.0]])]


def test_unsupported(spark):
    for name in ("a.xlsx", "a.shp", "a"):
        with pytest.raises(ValueError):
            files.read_layer(spark, name)


def test_exports_come_back(spark, tmp_path):
    frame = spark.createDataFrame([('say "hi"', "a,b"), ("x", "y\nz")], "a string, b string")
    files.write_csv(frame, f"{tmp_path}/out")
    assert '"say ""hi""","a,b"' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    again = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/out")
    assert sorted(again.collect()) == sorted(frame.collect())


def test_catalogs(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"layers": [{"id": " a ", "fields": ["y", "x ", "y"]}, {"id": "", "name": "n"}, {"id": "a", "name": "second"}]}))
    assert [tuple(r) for r in files.imported_layers(spark, f"{tmp_path}/l.json").collect()] == [("a", "a", ["x", "y"])]
    (tmp_path / "w.xml").write_text("<C><Layer><Name>n</Name></Layer><Layer><Name>n</Name><Title>T</Title></Layer><Layer><Title>no</Title></Layer></C>")
    assert [tuple(r) for r in files.fields_of_xml_layers(spark, f"{tmp_path}/w.xml").collect()] == [("n", "T")]


def test_feature_service(spark, tmp_path):
    features = [{"attributes": {"Valve_No": str(v)}, "geometry": {"x": v, "y": 0}} for v in (10, 2, 1, 2)]
    (tmp_path / "f.json").write_text(json.dumps({"features": features}))
    spark.dataSource.register(arcgis.ArcGisSource)
    found = spark.read.format("arcgis").options(path=f"{tmp_path}/f.json", page=2, pages=3).load()
    assert found.count() == 4 and found.agg(F.sum("x")).first()[0] == 15
    assert [r[0] for r in arcgis.valve_options(found).collect()] == ["1", "2", "10"]
    assert arcgis.query_url("http://h/0/?x=1", resultRecordCount="10") == "http://h/0/query?f=json&where=1%3D1&resultRecordCount=10"


def test_definitions(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"typeIdField": "Subtype", "fields": [{"name": "Status", "domain": {"codedValues": [{"code": 0, "name": "No"}, {"code": 1, "name": "Yes"}]}}]}))
    assert [tuple(r) for r in arcgis.coded_values(arcgis.layer_definition(spark, f"{tmp_path}/d.json")).collect()] == [("Status", "0", "No"), ("Status", "1", "Yes")]
    (tmp_path / "s.json").write_text(json.dumps({"layers": [{"id": 0, "name": "a"}, {"name": "no id"}], "tables": [{"id": 1, "name": "t"}]}))
    assert {r.url for r in arcgis.discovered_layers(spark, f"{tmp_path}/s.json", "http://h/S/").collect()} == {"http://h/S/0", "http://h/S/1"}
