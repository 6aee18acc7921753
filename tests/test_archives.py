"""Archives by their members, as streams."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from furrow.operators import forms
from furrow.sources import archives, files


def shapefile(n, first=0):
    """n points and their attribute table."""
    record = b"".join(struct.pack(">2i", k + 1, 10) + struct.pack("<i2d", 1, first + k, 2.0) for k in range(n))
    shp = struct.pack(">i", 9994) + bytes(96) + record
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15)
    dbf = bytes(4) + struct.pack("<IHH", n, 32 + 32 + 1, 9) + bytes(20) + field + b"\r" + b"".join(b" " + f"n{first + k}".encode().ljust(8) for k in range(n))
    return shp, dbf


def test_layers_of_an_archive_come_from_several_tasks(spark, tmp_path):
    for name, firsts in (("one.zip", (0, 10_000, 20_000)), ("two.zip", (30_000,))):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for k, first in enumerate(firsts):
                shp, dbf = shapefile(5_001, first)
                z.writestr(f"layer{k}.SHP", shp)
                if k != 1:
                    z.writestr(f"LAYER{k}.dbf", dbf)
            z.writestr("not.shp", b"no shapes")
            z.writestr("doc.kml", "<kml/>")
    found = files.read_layer(spark, f"{tmp_path}/*.zip")
    assert found.count() == 4 * 5_001
    named = found.select(F.col("props.NAME").alias("name"), F.col("coordinates")[0][0].cast("int").alias("x"), F.spark_partition_id().alias("task"))
    assert named.select("task").distinct().count() > 1
    assert named.filter("name IS NOT NULL AND name <> concat('n', x)").count() == 0 and named.filter("name IS NULL").count() == 5_001


def test_nothing_holds_an_archive_or_a_member_whole(spark, tmp_path):
    """A member of 400 MB under a bound on the memory of its reader."""
    with zipfile.ZipFile(tmp_path / "large.kmz", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("doc.kml", "w", force_zip64=True) as f:
        f.write(b'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>')
        mark = b"<Placemark><name>place</name><description>" + b"x" * 40_000 + b"</description><Point><coordinates>1,2,3</coordinates></Point></Placemark>"
        for _ in range(10_000):
            f.write(mark)
        f.write(b"</Document></kml>")
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with zipfile.ZipFile(tmp_path / "large.kmz") as z, z.open("doc.kml") as f:
        assert sum(len(points) for _, _, points in archives.placemarks(f)) == 10_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kilobytes
    found = files.read_layer(spark, f"{tmp_path}/large.kmz").agg(F.count("*"), F.sum(F.length("props.description")))
    assert tuple(found.first()) == (10_000, 400_000_000)


def test_broken_and_empty_archives(spark, tmp_path):
    shp, _ = shapefile(3)
    for name, members in (("cut.zip", {"a.shp": shp[:-5]}), ("none.zip", {"a.txt": b"x"}), ("kml.zip", {"b.shp": b"xx", "a.kml": b"<kml><Placemark><name>n</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark></kml>"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, raw in members.items():
                z.writestr(member, raw)
    with pytest.raises(Exception, match="ends within a record"):
        files.read_layer(spark, f"{tmp_path}/cut.zip").collect()
    assert files.read_layer(spark, f"{tmp_path}/none.zip").count() == 0
    assert [tuple(r) for r in files.read_layer(spark, f"{tmp_path}/kml.zip").collect()] == [({"name": "n"}, "LineString", [[1.0, 2.0], [3.0, 4.0]])]


def test_a_project_without_its_catalog_raises(spark):
    links = spark.createDataFrame([("1", "f", "r", "now")], "geo_id string, form_id string, permissions string, created_at string")
    with pytest.raises(ValueError, match="catalog"):
        forms.forms_of(links, "1", project="p")
    assert forms.forms_of(links, "1").count() == 1
