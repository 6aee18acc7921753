"""Layer files written from the tables and read back by the readers."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.plans.tables import table
from furrow.session import shared_folder
from furrow.sources import files
from furrow.sources.ranges import file_of


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places, with signs in their names that files must escape."""
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 5 == 0, 'say "a, b" \\').otherwise(""), "c_name")
    return table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"), "c_mktsegment", (k % 360 - 180).cast("double").alias("x"), (F.col("c_nationkey") - 12.5).alias("y"))


def _documents(rows: DataFrame, text: Column, begin: str, between: str, end: str, folder: str) -> None:
    """Files of fifty rows' texts each, with what a document begins and ends with."""
    pages = rows.groupBy(F.floor(F.col("id") / 50).alias("page")).agg(F.concat(F.lit(begin), F.array_join(F.collect_list(text), between), F.lit(end)).alias("text"))
    pages.select("text").write.option("maxRecordsPerFile", 1).text(folder)


def _summed(features: DataFrame, ident: Column) -> DataFrame:
    return features.select(ident.cast("long").alias("id"), F.col("props.name").alias("name"), "geometry_type", F.size("coordinates").cast("long").alias("points"), F.col("coordinates")[0][0].alias("x"), F.col("coordinates")[0][1].alias("y"))


def geojson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of fifty features each, points and lines, read in ranges of 4 KB."""
    p = _places(spark, sf_dir)
    point, line = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))), F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(F.array("x", "y"), F.array("y", "x")).alias("coordinates")))
    properties = F.to_json(F.struct("id", "name", F.col("c_mktsegment").alias("segment")))
    feature = F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": '), F.when(F.col("id") % 3 == 0, line).otherwise(point), F.lit("}"))
    folder = _folder(spark, "geojson")
    _documents(p, feature, '{"type": "FeatureCollection", "features": [', ",\n", "]}", folder)
    return _summed(files.read_geojson(spark, folder, 4096), F.col("props.id"))


def csv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "points")
    files.write_csv(_places(spark, sf_dir).select("id", "name", F.when(F.col("id") % 7 != 0, F.col("y").cast("string")).otherwise("none").alias("Latitude"), F.col("x").alias(" lng")), folder)
    return _summed(files.read_csv(spark, folder), F.col("props.id"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def kml_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir)
    shape = F.when(F.col("id") % 3 == 0, F.concat(F.lit("<LineString><coordinates>"), "x", F.lit(","), "y", F.lit(",0 "), "y", F.lit(","), "x", F.lit("</coordinates></LineString>"))).otherwise(F.concat(F.lit("<Point><coordinates>"), "x", F.lit(","), "y", F.lit("</coordinates></Point>")))
    mark = F.concat(F.lit("<Placemark><name>"), _escaped(F.concat(F.col("name"), F.lit(" <&>"))), F.lit("</name><description>"), "id", F.lit("</description>"), shape, F.lit("</Placemark>"))
    folder = _folder(spark, "kml")
    _documents(p, mark, '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "\n", "</Document></kml>", folder)
    return _summed(files.read_kml(spark, folder), F.col("props.description"))


def gpx_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir)
    tag = F.when(F.col("id") % 2 == 0, "wpt").otherwise("trkpt")
    mark = F.concat(F.lit("<"), tag, F.lit(' lat="'), "y", F.lit('" lon="'), "x", F.lit('"><ele>'), "id", F.lit("</ele><name>"), _escaped(F.col("name")), F.lit("</name></"), tag, F.lit(">"))
    folder = _folder(spark, "gpx")
    _documents(p, mark, '<gpx version="1.1">', "\n", "</gpx>", folder)
    found = files.read_gpx(spark, folder)
    return found.select(F.col("props.tag").alias("tag"), F.col("props.ele").cast("long").alias("id"), F.col("props.name").alias("name"), F.col("coordinates")[0][0].alias("x"), F.col("coordinates")[0][1].alias("y"))


def zipped_shapefiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each segment, with two layers of points and their attributes."""
    folder = _folder(spark, "archives")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for layer, part in rows.sort_values("id").groupby(rows["id"] % 2):
                records = b"".join(struct.pack(">2i", n + 1, 10) + struct.pack("<i2d", 1, x, y) for n, (x, y) in enumerate(zip(part["x"], part["y"], strict=True)))
                fields = b"".join(name.ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15) for name, size in ((b"id", 12), (b"name", 60)))
                attributes = b"".join(b" " + str(i).encode().ljust(12) + n.encode().ljust(60) for i, n in zip(part["id"], part["name"], strict=True))
                z.writestr(f"layer{layer}.shp", struct.pack(">i", 9994) + bytes(96) + records)
                z.writestr(f"layer{layer}.dbf", bytes(4) + struct.pack("<IHH", len(part), 32 + 64 + 1, 73) + bytes(20) + fields + b"\r" + attributes)
        system, place = file_of(folder)
        system.create_dir(place)
        with system.open_output_stream(f"{place}/{rows['c_mktsegment'].iloc[0]}-{rows['part'].iloc[0]}.zip") as f:
            f.write(data.getvalue())
        return pd.DataFrame({"written": [len(rows)]})

    parts = _places(spark, sf_dir).withColumn("part", F.floor(F.col("id") / 2000))  # so many places to an archive at most
    parts.groupBy("c_mktsegment", "part").applyInPandas(write, "written long").agg(F.sum("written")).collect()
    return _summed(files.read_archive(spark, f"{folder}/*.zip"), F.col("props.id"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of places as JSON lines, read back by Spark's own reader."""
    folder = _folder(spark, "lines")
    files.write_json(_places(spark, sf_dir), folder)
    return spark.read.schema("id long, name string, c_mktsegment string, x double, y double").json(folder)


QUERIES = {f.__name__: f for f in (geojson_files, csv_points, kml_places, gpx_points, zipped_shapefiles, json_lines)}

_PLACES = """places AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'say "a, b" \\' ELSE '' END || c_name AS name, c_mktsegment, (c_custkey % 360 - 180)::DOUBLE AS x, (c_nationkey - 12.5)::DOUBLE AS y FROM customer)"""
_LINES = f"WITH {_PLACES} SELECT id, name, CASE WHEN id % 3 = 0 THEN 'LineString' ELSE 'Point' END AS geometry_type, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS points, x, y FROM places"
ORACLES = {
    "geojson_files": _LINES,
    "csv_points": f"WITH {_PLACES} SELECT id, name, 'Point' AS geometry_type, 1::BIGINT AS points, x, y FROM places WHERE id % 7 <> 0",
    "kml_places": _LINES.replace("SELECT id, name,", "SELECT id, name || ' <&>' AS name,"),
    "gpx_points": f"WITH {_PLACES} SELECT CASE WHEN id % 2 = 0 THEN 'wpt' ELSE 'trkpt' END AS tag, id, name, x, y FROM places",
    "zipped_shapefiles": f"WITH {_PLACES} SELECT id, name, 'Point' AS geometry_type, 1::BIGINT AS points, x, y FROM places",
    "json_lines": f"WITH {_PLACES} SELECT * FROM places",
}
