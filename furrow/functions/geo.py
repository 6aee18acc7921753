"""Points, rings, scales and colours as column expressions.

A ring is an array of (longitude, latitude) arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
EARTH_CIRCUMFERENCE = 40075016.68557849
#: The map scale's denominator at zoom 0.
SCALE_AT_ZERO = 591657550.5
TILE = 512

# The colours of each ramp from low to high.
RAMPS = {
    "blues": ["#eff6ff", "#bfdbfe", "#60a5fa", "#2563eb", "#1e3a8a"],
    "greens": ["#f0fdf4", "#bbf7d0", "#4ade80", "#16a34a", "#14532d"],
    "plasma": ["#0d0887", "#7e03a8", "#cc4778", "#f89540", "#f0f921"],
    "magma": ["#000004", "#3b0f70", "#8c2981", "#de4968", "#fe9f6d", "#fcfdbf"],
    "turbo": ["#30123b", "#3b4cc0", "#26a6d1", "#3de07e", "#f9e721", "#f20c0c"],
    "viridis": ["#440154", "#3b528b", "#21918c", "#5ec962", "#fde725"],
}


def scale_from_zoom(zoom: Column) -> Column:
    return F.lit(SCALE_AT_ZERO) / F.pow(F.lit(2.0), zoom)


def zoom_from_scale(scale: Column) -> Column:
    return F.log2(F.lit(SCALE_AT_ZERO) / scale)


def metres_per_pixel(latitude: Column, zoom: Column, tile: int = TILE) -> Column:
    return F.lit(EARTH_CIRCUMFERENCE) * F.cos(F.radians(latitude)) / (F.lit(float(tile)) * F.pow(F.lit(2.0), zoom))


def wkt_ring(wkt: Column) -> Column:
    """The outer ring of a POLYGON, or the point of a POINT as a ring of one; null for any other text."""
    body = F.coalesce(F.nullif(F.regexp_extract(wkt, r"^POLYGON\(\(([^()]*)\)", 1), F.lit("")), F.nullif(F.regexp_extract(wkt, r"^POINT\(([^()]*)\)$", 1), F.lit("")))
    points = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.try_cast("double")))
    good = F.forall(points, lambda p: (F.size(p) >= 2) & F.forall(p, lambda v: v.isNotNull()))
    return F.when(good, points)


def bounds(ring: Column) -> Column:
    """west, south, east, north."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def bounds_centre(ring: Column) -> Column:
    box = bounds(ring)
    return F.array((box["west"] + box["east"]) / 2, (box["south"] + box["north"]) / 2)


def middle_vertex(ring: Column) -> Column:
    return F.get(ring, F.floor(F.size(ring) / 2).cast("int"))


def vertex_count(rings: Column) -> Column:
    """Points of the first ring."""
    return F.coalesce(F.size(F.get(rings, 0)), F.lit(0))


def area_hectares(ring: Column) -> Column:
    """The area of an outer ring on the sphere, two decimals."""
    n = F.size(ring)
    places = F.sequence(F.lit(0), n - 1)

    def part(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        return F.radians(q[0] - p[0]) * (2 + F.sin(F.radians(p[1])) + F.sin(F.radians(q[1])))

    total = F.aggregate(F.transform(places, part), F.lit(0.0), lambda a, x: a + x)
    area = F.abs(total) * (EARTH_RADIUS * EARTH_RADIUS / 2) / 10000
    return F.when(n >= 3, F.floor(area * 100 + 0.5) / 100).otherwise(F.lit(0.0))


def geometry_kind(geometry_type: Column) -> Column:
    return F.when(geometry_type.isin("Point", "MultiPoint"), "point").when(geometry_type.isin("LineString", "MultiLineString"), "line").when(geometry_type.isin("Polygon", "MultiPolygon"), "polygon").otherwise("unknown")


def point_feature(longitude: Column, latitude: Column, props: Column) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(longitude, latitude).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))


def coordinate_text(latitude: Column, longitude: Column) -> Column:
    return F.format_string("%.5f, %.5f", latitude, longitude)


def hex_to_rgb(colour: str) -> tuple[int, int, int]:
    digits = colour.lstrip("#")
    digits = "".join(2 * d for d in digits) if len(digits) == 3 else digits
    return int(digits[:2], 16), int(digits[2:4], 16), int(digits[4:6], 16)


def rgb_to_hex(rgb: tuple[float, float, float]) -> str:
    return "#" + "".join(f"{max(0, min(255, math.floor(v + 0.5))):02x}" for v in rgb)


def ramp_colours(name: str, classes: int) -> list[str]:
    """So many colours along a ramp, mixed linearly."""
    stops = [hex_to_rgb(c) for c in RAMPS.get(name, RAMPS["viridis"])]
    out = []
    for k in range(classes):
        at = (len(stops) - 1) * (k / (classes - 1) if classes > 1 else 0.5)
        low = min(int(at), len(stops) - 2)
        out.append(rgb_to_hex(tuple(a + (b - a) * (at - low) for a, b in zip(stops[low], stops[low + 1], strict=True))))
    return out


def darkened(colour: str, by: float = 0.2) -> str:
    return rgb_to_hex(tuple(v * (1 - by) for v in hex_to_rgb(colour)))


def class_colour(index: Column, name: str, classes: int) -> Column:
    return F.get(F.array(*[F.lit(c) for c in ramp_colours(name, classes)]), index)


def class_widths(classes: int, low: float = 1.5, high: float = 6.0) -> list[float]:
    return [low + (high - low) * (k / (classes - 1) if classes > 1 else 0.0) for k in range(classes)]


# Dashes from the lightest to the densest class.
DASHES = ["1 10", "1 7", "1 5", "1 3.5", "1 2.5", "1 2", "1 1.6", "1 1.3", "1 1.1"]
# The map's first view and the screen it is meant for.
FIRST_SCALE, FIRST_LATITUDE, DPI, INCHES_PER_METRE, BASE_RESOLUTION = 100_000_000, 20.0, 96, 39.37, 156543.03392804097


def class_dashes(classes: int) -> list[str]:
    """A dash pattern for each class, three at least and nine at most."""
    return DASHES[: max(3, min(len(DASHES), classes))]


def initial_zoom(scale: float = FIRST_SCALE, latitude: float = FIRST_LATITUDE) -> float:
    """The zoom, to a tenth, at which a map has a scale's denominator at a latitude."""
    metres = scale / (DPI * INCHES_PER_METRE)
    zoom = math.log2(BASE_RESOLUTION * math.cos(math.radians(latitude)) / metres)
    return max(0.0, min(22.0, math.floor(zoom * 10 + 0.5) / 10))


def legend_labels(breaks: Column) -> Column:
    """low – high with two decimals for each class."""
    return F.transform(F.sequence(F.lit(0), F.size(breaks) - 2), lambda i: F.format_string("%.2f – %.2f", F.get(breaks, i), F.get(breaks, i + 1)))
