"""Readers and writers of layer files: CSV points, GeoJSON, KML, KMZ, GPX, zipped shapefiles, and quoted CSV and JSON exports.

Every reader gives features: props (a map of texts), geometry_type and coordinates (points as arrays), except that a
CSV without coordinates gives its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.catalog import fallback_rows
from furrow.sources import geojson
from furrow.sources.archives import read_archive

LATITUDE, LONGITUDE = ("lat", "latitude", "y"), ("lon", "lng", "longitude", "x")
#: Rows of an export that is one text.
MAX_EXPORT = 10_000


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """Reads a file by the end of its name; xlsx, xls, a bare shp and anything unknown raise ValueError."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    readers = {"csv": read_csv, "json": read_geojson, "geojson": read_geojson, "kml": read_kml, "gpx": read_gpx, "kmz": read_archive, "zip": read_archive}
    if kind == "shp":
        raise ValueError("a shapefile must come zipped with its other parts")
    if kind not in readers:
        raise ValueError(f"unsupported file type {kind!r}")
    return readers[kind](spark, path)


def coordinate_columns(columns: list[str]) -> tuple[str, str] | None:
    """The (longitude, latitude) columns by their names in any case, or None."""
    lower = {c.lower().strip(): c for c in reversed(columns)}
    lat = next((lower[n] for n in LATITUDE if n in lower), None)
    lon = next((lower[n] for n in LONGITUDE if n in lower), None)
    return (lon, lat) if lat and lon else None


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Point features where there are coordinate columns, rows without numbers in them left out; else a table."""
    plain = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    names = plain.csv(path).columns
    found = coordinate_columns(names)
    if not found:
        return plain.option("inferSchema", True).csv(path)
    rows = plain.csv(path)  # texts; no second reading to infer types
    lon, lat = (F.col(f"`{c}`").try_cast("double") for c in found)
    props = F.create_map(*[x for c in names if c not in found for x in (F.lit(c), F.col(f"`{c}`"))]) if len(names) > 2 else F.create_map().cast("map<string,string>")
    return rows.filter(lon.isNotNull() & lat.isNotNull()).select(props.alias("props"), F.lit("Point").alias("geometry_type"), F.array(F.array(lon, lat)).alias("coordinates"))


def _flat_points(kind: Column, text: Column) -> Column:
    """The points of a geometry's coordinates as JSON, rings one after another."""
    one, line, rings, many = (F.from_json(text, t) for t in ("array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"))
    return F.when(kind == "Point", F.array(one)).when(kind.isin("LineString", "MultiPoint"), line).when(kind.isin("Polygon", "MultiLineString"), F.flatten(rings)).when(kind == "MultiPolygon", F.flatten(F.flatten(many)))


#: A geometry's coordinates are kept as text until its type says how deep they are.
_FEATURE_JSON = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def read_geojson(spark: SparkSession, path: str, range_bytes: int = geojson.RANGE_BYTES) -> DataFrame:
    """The features of collections, or single features, a document to a file; large files are read by many tasks."""
    features = geojson.feature_texts(spark, path, range_bytes).select(F.from_json("feature", _FEATURE_JSON).alias("f")).filter("f.type = 'Feature'")
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    props = F.coalesce("f.properties", F.create_map().cast("map<string,string>"))
    return features.select(props.alias("props"), kind.alias("geometry_type"), _flat_points(kind, text).alias("coordinates"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Way points and track points, as points with their tag."""
    parts = []
    for tag in ("wpt", "trkpt"):
        rows = spark.read.format("xml").option("rowTag", tag).schema("_lat double, _lon double, name string, ele string, time string").load(path)
        props = F.map_filter(F.create_map(F.lit("tag"), F.lit(tag), F.lit("name"), F.col("name"), F.lit("ele"), F.col("ele"), F.lit("time"), F.col("time")), lambda _, v: v.isNotNull())
        parts.append(rows.filter("_lat IS NOT NULL AND _lon IS NOT NULL").select(props.alias("props"), F.lit("Point").alias("geometry_type"), F.array(F.array("_lon", "_lat")).alias("coordinates")))
    return parts[0].unionByName(parts[1])


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with their name, description, extended data, and the points of their first geometry."""
    shape = "struct<coordinates:string>"
    ring = f"struct<outerBoundaryIs:struct<LinearRing:{shape}>>"
    data = "struct<Data:array<struct<_name:string,value:string>>>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(f"name string, description string, ExtendedData {data}, Point {shape}, LineString {shape}, Polygon {ring}").load(path)
    kind = F.when(F.col("Point").isNotNull(), "Point").when(F.col("LineString").isNotNull(), "LineString").when(F.col("Polygon").isNotNull(), "Polygon")
    text = F.coalesce("Point.coordinates", "LineString.coordinates", "Polygon.outerBoundaryIs.LinearRing.coordinates")
    more = F.coalesce(F.map_from_entries(F.transform("ExtendedData.Data", lambda d: F.struct(d["_name"], d["value"]))), F.create_map().cast("map<string,string>"))
    props = F.map_concat(F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("description"), F.col("description")), lambda _, v: v.isNotNull()), more)
    return rows.select(props.alias("props"), kind.alias("geometry_type"), _kml_points(text).alias("coordinates"))


def _kml_points(text: Column) -> Column:
    places = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    return F.transform(places, lambda p: F.transform(F.slice(F.split(p, ","), 1, 2), lambda v: v.try_cast("double")))


def write_csv(rows: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A row to a line, for tables of any size."""
    rows.write.json(path)


def pretty_json(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: `json`, an indented array of the rows in order. For an export that a person reads: it is one text, so ValueError beyond MAX_EXPORT rows."""
    if rows.limit(MAX_EXPORT + 1).count() > MAX_EXPORT:
        raise ValueError(f"more than {MAX_EXPORT} rows: write_json takes any number")
    item = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"])
    return rows.agg(F.to_json(listed, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def with_fallback(features: DataFrame, *saved: DataFrame) -> DataFrame:
    """A catalog's layers (id, …) with those of the other catalogs that it lacks, the first that has one counting."""
    out = features
    for other in saved:
        out = fallback_rows(out, other, "id")
    return out


def fields_of_xml_layers(spark: SparkSession, path: str) -> DataFrame:
    """name and title of a map service's named layers, the title from the name where it is missing, each name once."""
    layers = spark.read.format("xml").option("rowTag", "Layer").schema("Name string, Title string").load(path)
    return layers.filter("Name IS NOT NULL AND trim(Name) <> ''").groupBy(F.col("Name").alias("name")).agg(F.coalesce(F.first("Title", ignorenulls=True), F.first("Name")).alias("title"))


def imported_layers(spark: SparkSession, path: str) -> DataFrame:
    """A layer catalog from JSON, an array or {layers: […]}: ids trimmed and required, names from ids, fields in order and once, each id once."""
    item = "array<struct<id:string,name:string,fields:array<string>>>"
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.coalesce(F.from_json(F.get_json_object("value", "$.layers"), item), F.from_json("value", item))).alias("seq", "l"))
    ident = F.trim("l.id")
    rows = items.filter(F.coalesce(ident, F.lit("")) != "").select("seq", ident.alias("id"), F.coalesce(F.nullif(F.trim("l.name"), F.lit("")), ident).alias("name"), F.array_sort(F.array_distinct(F.filter(F.transform("l.fields", lambda f: F.trim(f)), lambda f: f != ""))).alias("fields"))
    return rows.groupBy("id").agg(F.min_by(F.struct("name", "fields"), "seq").alias("l")).select("id", "l.name", "l.fields")
