"""Queries over raster files, and over areas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import js
from furrow.operators import areas, raster
from furrow.plans.tables import BANDS, PIXELS_SQL, pixels, table
from furrow.session import shared_folder
from furrow.sources import raster as rasters

#: The bands written, and the cells of a scene each way: pixels that fall on one cell in a quarter of a year are averaged.
WRITTEN, CELLS = ("B03", "B04", "B08"), 512
BOX = (100, 60, 420, 300)


def scene_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each quarter of a year: cells of size 1 with the means of their bands."""
    time = F.date_trunc("quarter", F.col("time"))
    cells = pixels(spark, sf_dir).select(time.alias("time"), (F.pmod("x", F.lit(CELLS)) + 0.5).alias("x"), (F.pmod("y", F.lit(CELLS)) + 0.5).alias("y"), *BANDS)
    means = cells.groupBy("time", "x", "y").agg(*[F.avg(b).alias(b) for b in WRITTEN])
    return means.select(F.date_format("time", "yyyyMM").alias("scene_id"), "time", F.lit(5.0).alias("cloud_cover"), "x", "y", *WRITTEN)


_CELLS_SQL = f"""{PIXELS_SQL}, cells AS (
    SELECT date_trunc('quarter', time) AS time, x % {CELLS} + 0.5 AS x, y % {CELLS} + 0.5 AS y, """ + ", ".join(f"avg({b}) AS {b}" for b in WRITTEN) + " FROM pixels GROUP BY ALL)"


def _written(spark: SparkSession, sf_dir: str) -> str:
    folder = f"{shared_folder(spark)}/scenes-{uuid.uuid4().hex}"
    rasters.write_scenes(scene_cells(spark, sf_dir), list(WRITTEN), folder, step=1.0)
    return f"{folder}/catalog"


def raster_scan_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of two indices over a box and a period, read from raster files."""
    found = rasters.read_scenes(spark, _written(spark, sf_dir), list(WRITTEN))
    west, south, east, north = BOX
    found = found.filter((F.col("time") >= F.lit("1994-01-01").cast("timestamp")) & (F.col("time") < F.lit("1997-01-01").cast("timestamp")))
    found = found.filter((F.col("x") >= west) & (F.col("x") <= east) & (F.col("y") >= south) & (F.col("y") <= north))
    series = raster.time_series(found, ["NDVI", "NDWI"])
    return series.select("index", F.date_format("time", "yyyy-MM-dd").alias("date"), js.quantised(F.col("value")).alias("value"))


def raster_scan_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all scenes as files give them back: how many, and the sums of their bands."""
    found = rasters.read_scenes(spark, _written(spark, sf_dir), list(WRITTEN))
    return found.groupBy("scene_id").agg(F.count("*").alias("cells"), *[js.quantised(F.sum(b), 3).alias(b.lower()) for b in WRITTEN], F.max("x").alias("east"), F.min("y").alias("south"))


def fields_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle for each nation, with a hole in every third."""
    k = F.col("n_nationkey").cast("double")

    def ring(*points: tuple) -> Column:
        return F.array(*[F.struct((x * 1.0).alias("x"), (y * 1.0).alias("y")) for x, y in points])

    west, south = 70 * k, (k * 37) % 80
    outer, hole = ring((west, south), (west + 300, south + 5), (west + 50, south + 40)), ring((west + 90, south + 9), (west + 130, south + 10), (west + 100, south + 20))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area_id"), F.when(k % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))


def area_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels, their mean index and cover of each nation's area."""
    found = areas.within_areas(pixels(spark, sf_dir), fields_of_nations(spark, sf_dir))
    return found.groupBy("area_id").agg(F.count("*").alias("pixels"), F.countDistinct("x", "y").alias("places"), js.quantised(F.avg("B04")).alias("mean_b04"))


#: An area of interest with five corners.
AREA = [[(150.0, 20.0), (900.0, 5.0), (1200.0, 60.0), (500.0, 95.0), (420.0, 40.0)]]


def area_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.time_series(areas.clip_to_area(pixels(spark, sf_dir), AREA), ["NDVI"])
    return found.select(F.date_format("time", "yyyy-MM-dd").alias("date"), js.quantised(F.col("value")).alias("value"))


def area_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes (boxes of a hundred by ten, by order) that an area has a point in common with."""
    orders = table(spark, sf_dir, "orders").filter("o_orderdate >= '1998-01-01'")
    west, south = (F.col("o_custkey") % 150 * 10).cast("double"), (F.col("o_orderkey") % 97).cast("double")
    boxes = orders.select(F.col("o_orderkey").alias("scene_id"), west.alias("west"), south.alias("south"), (west + 100).alias("east"), (south + 10).alias("north"))
    return areas.scenes_of_area(boxes, AREA).select("scene_id")


def _in_ring(points: list[tuple[str, str]], x: str, y: str) -> str:
    """Whether a point is strictly or weakly on the inner side of all edges of a convex ring, whichever way it turns."""
    sides = [f"(({b[0]}) - ({a[0]})) * ({y} - ({a[1]})) - (({b[1]}) - ({a[1]})) * ({x} - ({a[0]}))" for a, b in zip(points, [*points[1:], points[0]], strict=True)]
    return f"least({', '.join(sides)}) >= 0 OR greatest({', '.join(sides)}) <= 0"


_WEST, _SOUTH = "70 * n_nationkey", "n_nationkey * 37 % 80"
_OUTER = [(_WEST, _SOUTH), (f"{_WEST} + 300", f"{_SOUTH} + 5"), (f"{_WEST} + 50", f"{_SOUTH} + 40")]
_HOLE = [(f"{_WEST} + 90", f"{_SOUTH} + 9"), (f"{_WEST} + 130", f"{_SOUTH} + 10"), (f"{_WEST} + 100", f"{_SOUTH} + 20")]
_STRICT = _in_ring(_HOLE, "x", "y").replace(">= 0", "> 0").replace("<= 0", "< 0")


def _even_odd(x: str, y: str) -> str:
    """AREA by divisions, beside an edge test."""
    ring = AREA[0]
    pairs = list(zip(ring, [*ring[1:], ring[0]], strict=True))
    crossed = " + ".join(f"CASE WHEN ({a[1]} > {y}) <> ({b[1]} > {y}) AND {x} < ({b[0] - a[0]})::DOUBLE * ({y} - {a[1]}) / {b[1] - a[1]} + {a[0]} THEN 1 ELSE 0 END" for a, b in pairs)
    on = " OR ".join(f"(({b[0] - a[0]}) * ({y} - {a[1]}) = ({b[1] - a[1]}) * ({x} - {a[0]}) AND {x} BETWEEN {min(a[0], b[0])} AND {max(a[0], b[0])} AND {y} BETWEEN {min(a[1], b[1])} AND {max(a[1], b[1])})" for a, b in pairs)
    return f"(({crossed}) % 2 = 1 OR {on})"


def _segments_meet() -> str:
    """Whether one of AREA's edges meets one of a box's sides, by the orders of four points."""
    ring = AREA[0]
    corners = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north")]
    tests = []
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        for p, q in zip(corners, [*corners[1:], corners[0]], strict=True):
            side = lambda o, s, t: f"sign((({s[0]}) - ({o[0]})) * (({t[1]}) - ({o[1]})) - (({s[1]}) - ({o[1]})) * (({t[0]}) - ({o[0]})))"
            tests.append(f"({side(a, b, p)} * {side(a, b, q)} <= 0 AND {side(p, q, a)} * {side(p, q, b)} <= 0)")
    return " OR ".join(tests)


QUERIES = {f.__name__: f for f in (raster_scan_series, raster_scan_pixels, area_pixels, area_series, area_scenes)}

ORACLES = {
    "raster_scan_series": f"""
        WITH {_CELLS_SQL}
        SELECT i.index, strftime(time, '%Y-%m-%d') AS date,
               floor(avg(CASE i.index WHEN 'NDVI' THEN (B08 - B04) / nullif(B08 + B04, 0) ELSE (B03 - B08) / nullif(B03 + B08, 0) END) * 1e6 + 0.5) / 1e6 AS value
        FROM cells, (VALUES ('NDVI'), ('NDWI')) AS i (index)
        WHERE time >= TIMESTAMP '1994-01-01' AND time < TIMESTAMP '1997-01-01' AND x BETWEEN {BOX[0]} AND {BOX[2]} AND y BETWEEN {BOX[1]} AND {BOX[3]}
        GROUP BY ALL HAVING value IS NOT NULL""",
    "raster_scan_pixels": f"""
        WITH {_CELLS_SQL}
        SELECT strftime(time, '%Y%m') AS scene_id, count(*) AS cells, """
    + ", ".join(f"floor(sum({b}) * 1e3 + 0.5) / 1e3 AS {b.lower()}" for b in WRITTEN)
    + """, max(x) AS east, min(y) AS south FROM cells GROUP BY ALL""",
    "area_pixels": f"""
        WITH {PIXELS_SQL}
        SELECT n_nationkey AS area_id, count(*) AS pixels, count(DISTINCT (x, y)) AS places, floor(avg(B04) * 1e6 + 0.5) / 1e6 AS mean_b04
        FROM pixels JOIN nation ON x BETWEEN {_WEST} AND {_WEST} + 300 AND ({_in_ring(_OUTER, "x", "y")}) AND NOT (n_nationkey % 3 = 0 AND ({_STRICT})) GROUP BY 1""",
    "area_series": f"""
        WITH {PIXELS_SQL}
        SELECT strftime(time, '%Y-%m-%d') AS date, floor(avg((B08 - B04) / nullif(B08 + B04, 0)) * 1e6 + 0.5) / 1e6 AS value
        FROM pixels WHERE {_even_odd("x", "y")} GROUP BY time HAVING value IS NOT NULL""",
    "area_scenes": f"""
        WITH boxes AS (SELECT o_orderkey AS scene_id, (o_custkey % 150 * 10)::DOUBLE AS west, (o_orderkey % 97)::DOUBLE AS south, west + 100 AS east, south + 10 AS north FROM orders WHERE o_orderdate >= '1998-01-01')
        SELECT scene_id FROM boxes WHERE {_even_odd("west", "south")} OR {" OR ".join(f"({x} BETWEEN west AND east AND {y} BETWEEN south AND north)" for x, y in AREA[0])} OR {_segments_meet()}""",
}
