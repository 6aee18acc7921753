"""Inserting locations: validation, unique sites, and the attributes and form links that come with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geo, text
from furrow.operators.layers import attributes_long

MAX_VERTICES = 1000
REQUIRED = ("country", "site", "project", "date", "wkt")
ATTRIBUTES = ("country", "site", "project", "project_id", "zone_id", "code_id", "date")

# Fixed values.
GEOMETRY_TYPES = ("marker", "polygon", "polyline", "circle", "Point", "Polygon", "LineString", "Circle")
ACTIONS = ("create", "read", "update", "delete")


@dataclass(frozen=True)
class Inserted:
    """The new locations, their attributes (geo_id, field, value, ts), form links, and what was rejected with its errors."""

    locations: DataFrame
    attributes: DataFrame
    links: DataFrame
    rejected: DataFrame


def checked(new: DataFrame) -> DataFrame:
    """Zones and codes in capitals, and `errors`, an array."""
    upper = new.withColumns({"zone_id": F.upper("zone_id"), "code_id": F.upper("code_id")})
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"{c} is required") for c in REQUIRED]
    matches = [F.when(~F.coalesce(F.col(c).rlike(p), F.lit(False)), f"{c} is malformed") for c, p in (("zone_id", "^[A-Z0-9]{3}$"), ("code_id", "^[A-Z0-9]{8}$"))]
    kind = F.when(~F.coalesce(F.col("geometry_type").isin(*GEOMETRY_TYPES), F.lit(False)), "unknown geometry type")
    complex_ = F.when(geo.vertex_count(F.col("rings")) > MAX_VERTICES, f"more than {MAX_VERTICES} vertices")
    actions = F.flatten(F.transform(F.coalesce("forms", F.array().cast("array<struct<id:string,permissions:array<string>>>")), lambda f: f["permissions"]))
    unknown = F.when(F.size(F.array_except(actions, F.array(*[F.lit(a) for a in ACTIONS]))) > 0, "unknown permission")
    return upper.withColumn("errors", F.array_compact(F.array(*missing, *matches, kind, complex_, unknown)))


def insert(existing: DataFrame, new: DataFrame) -> Inserted:
    """new has geo_id, seq, ts, the location's columns, rings and forms; a site is unique under key normalisation, and of new ones the first wins."""
    rows = checked(new).withColumn("site_key", text.normal_key(F.col("site")))
    taken = existing.select(text.normal_key(F.col("site")).alias("taken_key")).distinct()
    good = rows.filter(F.size("errors") == 0)
    first = good.withColumn("nth", F.row_number().over(Window.partitionBy("site_key").orderBy("seq")))
    marked = first.join(taken, F.col("site_key") == F.col("taken_key"), "left")
    free = (F.col("nth") == 1) & F.col("taken_key").isNull()
    kept = marked.filter(free).drop("nth", "taken_key", "errors", "site_key")
    double = marked.filter(~free).select("geo_id", F.array(F.lit("site must be unique")).alias("errors"))
    links = kept.select("geo_id", "ts", F.explode("forms").alias("f")).select("geo_id", F.col("f.id").alias("form_id"), F.col("f.permissions").alias("permissions"), "ts")
    rejected = rows.filter(F.size("errors") > 0).select("geo_id", "errors").unionByName(double)
    return Inserted(kept, attributes_long(kept, "geo_id", list(ATTRIBUTES), ts=F.col("ts")), links, rejected)
