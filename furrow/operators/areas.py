"""Points and scenes by areas: polygons with holes, by the even-odd rule, their edges included.

within_areas() covers each area by cells of a quadtree: from the cell around its box downwards, cells that no edge touches are either dropped or, where they lie inside, kept whole; the others are cut in four, LEVELS times.
Points meet areas in equal cells alone. In cells that lie inside nothing is left to test; in those at the edge the point is tested against the area's edges, in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import stored

#: How often the cell around an area is cut: at the edges, cells of a sixteenth of its size.
LEVELS = 4
#: Cells that are broadcast at most, some 64 bytes each and the edges of their area. Beyond them the join shuffles.
MOST_CELLS = 50_000
#: Cells have a side of 2 to the power of their scale; 0.0000001 to 10^9 of whatever unit.
_SCALES = (-24, 30)

Ring = list[tuple[float, float]]


def edges_of(rings: Column) -> Column:
    """The edges (x1, y1, x2, y2) of rings, arrays of (x, y); a ring that isn't closed is."""

    def of_ring(ring: Column) -> Column:
        last = F.element_at(ring, -1)
        closed = F.when(F.size(ring) > 0, F.concat(F.array(last), ring))
        pairs = F.arrays_zip(F.slice(closed, 1, F.size(ring)).alias("a"), ring.alias("b"))
        named = F.transform(pairs, lambda p: F.struct(p["a"]["x"].alias("x1"), p["a"]["y"].alias("y1"), p["b"]["x"].alias("x2"), p["b"]["y"].alias("y2")))
        return F.filter(F.coalesce(named, F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")), lambda e: e["x1"].isNotNull() & e["x2"].isNotNull() & e["y1"].isNotNull() & e["y2"].isNotNull())

    return F.flatten(F.transform(rings, of_ring))


def rings_of(rings: list[Ring]) -> Column:
    """Rings as a column."""
    return F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring]) for ring in rings])


def _side(e: Column, x: Column, y: Column) -> Column:
    """Over, under or on the line of an edge."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in an area or on its edge."""
    on = F.exists(edges, lambda e: (_side(e, x, y) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    # An edge that passes the point's height and lies to its right is crossed; the side says so without a division.
    def crossed(e: Column) -> Column:
        up = e["y2"] > e["y1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & F.when(up, _side(e, x, y) > 0).otherwise(_side(e, x, y) < 0)

    return on | (F.size(F.filter(edges, crossed)) % 2 == 1)


def _touches(edges: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether an edge has a point in a box: their boxes meet, and not all corners lie on one side of it."""

    def touched(e: Column) -> Column:
        meets = (F.least(e["x1"], e["x2"]) <= east) & (F.greatest(e["x1"], e["x2"]) >= west) & (F.least(e["y1"], e["y2"]) <= north) & (F.greatest(e["y1"], e["y2"]) >= south)
        sides = [_side(e, x, y) for x in (west, east) for y in (south, north)]
        return meets & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(edges, touched)


def intersects_box(edges: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether an area and a box have a point in common."""
    return _touches(edges, west, south, east, north) | inside(edges, west, south)


def cover(areas: DataFrame) -> DataFrame:
    """area_id, edges, scale, cell_x, cell_y and whole of the quadtree cells of areas(area_id, rings). An area without edges has none."""
    known = areas.select("area_id", edges_of(F.col("rings")).alias("edges")).filter(F.size("edges") > 0)
    sides = {n: F.flatten(F.array(F.col(f"edges.{n}1"), F.col(f"edges.{n}2"))) for n in ("x", "y")}
    boxed = known.select("area_id", "edges", *[f(sides[n]).alias(f"{kind}_{n}") for n in ("x", "y") for kind, f in (("low", F.array_min), ("high", F.array_max))])
    extent = F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y"))
    scale = F.greatest(F.least(F.ceil(F.log2(F.greatest(extent, F.lit(2.0 ** _SCALES[0])))), F.lit(_SCALES[1])), F.lit(_SCALES[0])).cast("int")
    size = F.pow(F.lit(2.0), "scale")
    # The box touches at most two cells each way.
    start = boxed.withColumn("scale", scale)
    ranges = {n: F.sequence(F.floor(F.col(f"low_{n}") / size), F.floor(F.col(f"high_{n}") / size)) for n in ("x", "y")}
    cells = start.select("area_id", "edges", "scale", F.explode(ranges["x"]).alias("cell_x"), "low_y", "high_y").select("area_id", "edges", "scale", "cell_x", F.explode(ranges["y"]).alias("cell_y"))

    def judged(cells: DataFrame) -> DataFrame:
        west, south = F.col("cell_x") * size, F.col("cell_y") * size
        touched = _touches(F.col("edges"), west, south, west + size, south + size)
        kept = cells.withColumn("whole", ~touched)
        return kept.filter(~F.col("whole") | inside(F.col("edges"), west + size / 2, south + size / 2))

    done = judged(cells)
    for _ in range(LEVELS):
        quarters = F.explode(F.array(*[F.struct((F.col("cell_x") * 2 + i).alias("x"), (F.col("cell_y") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)]))
        cut = done.filter(~F.col("whole")).select("area_id", "edges", (F.col("scale") - 1).alias("scale"), quarters.alias("q")).select("area_id", "edges", "scale", F.col("q.x").alias("cell_x"), F.col("q.y").alias("cell_y"))
        done = stored(done.filter("whole").unionByName(judged(cut)), "area-cells")
    return done


def within_areas(points: DataFrame, areas: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """area_id and the columns of every point in each of the areas(area_id, rings) that it lies in or on the edge of."""
    cells = cover(areas)
    scales = sorted(r.scale for r in cells.select("scale").distinct().collect())  # some fifty at most
    if not scales:
        return points.limit(0).select(F.lit(None).cast(areas.schema["area_id"].dataType).alias("area_id"), *points.columns)
    size = F.pow(F.lit(2.0), "at")
    placed = points.select(F.struct(*[points[f"`{c}`"] for c in points.columns]).alias("point"), points[x].cast("double").alias("px"), points[y].cast("double").alias("py"), F.explode(F.array(*map(F.lit, scales))).alias("at"))
    placed = placed.select("point", "px", "py", "at", F.floor(F.col("px") / size).alias("in_x"), F.floor(F.col("py") / size).alias("in_y"))
    n = cells.count()
    found = placed.join(F.broadcast(cells) if n <= MOST_CELLS else cells, (F.col("at") == F.col("scale")) & (F.col("in_x") == F.col("cell_x")) & (F.col("in_y") == F.col("cell_y")))
    found = found.filter(F.col("whole") | inside(F.col("edges"), F.col("px"), F.col("py")))
    return found.select("area_id", "point.*")


def clip_to_area(pixels: DataFrame, rings: list[Ring]) -> DataFrame:
    """The pixels in one area; its box is tested first, which scans can use."""
    xs, ys = ([p[k] for ring in rings for p in ring] for k in (0, 1))
    if not xs:
        return pixels.limit(0)
    boxed = pixels.filter(F.col("x").between(float(min(xs)), float(max(xs))) & F.col("y").between(float(min(ys)), float(max(ys))))
    return boxed.filter(inside(edges_of(rings_of(rings)), F.col("x"), F.col("y")))


def scenes_of_area(scenes: DataFrame, rings: list[Ring]) -> DataFrame:
    """The scenes whose box has a point in common with an area."""
    xs, ys = ([p[k] for ring in rings for p in ring] for k in (0, 1))
    if not xs:
        return scenes.limit(0)
    near = scenes.filter((F.col("west") <= float(max(xs))) & (F.col("east") >= float(min(xs))) & (F.col("south") <= float(max(ys))) & (F.col("north") >= float(min(ys))))
    return near.filter(intersects_box(edges_of(rings_of(rings)), *(F.col(c) for c in ("west", "south", "east", "north"))))
