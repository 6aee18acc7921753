"""Raster files: written and read back, pruned by tiles, at several resolutions, and files of other writers."""

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from furrow.sources import raster


def tiff(path, cells, tile, step, west, north, order="<", dtype="u2", predictor=1, compression=8, nodata=None):
    """A plain TIFF file, made by other rules than the library's writer."""
    high, wide = cells.shape
    down, across = -(-high // tile), -(-wide // tile)
    blobs = []
    for r in range(down):
        for c in range(across):
            part = np.zeros((tile, tile), np.dtype(order + dtype))
            own = cells[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]
            part[: own.shape[0], : own.shape[1]] = own
            if predictor == 2:
                part[:, 1:] = np.diff(part, axis=1)
            blobs.append(zlib.compress(part.tobytes()) if compression == 8 else part.tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[dtype[0]]
    tags = {256: ("H", [wide]), 257: ("H", [high]), 258: ("H", [8 * int(dtype[1])]), 259: ("H", [compression]), 277: ("H", [1]), 317: ("H", [predictor]), 322: ("H", [tile]), 323: ("H", [tile]), 339: ("H", [kind])}
    tags |= {33550: ("d", [step, step, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, west, north, 0.0])}
    if nodata is not None:
        tags[42113] = ("c", [bytes([b]) for b in f"{nodata}\0".encode()])
    at = 8 + sum(map(len, blobs))
    tags |= {324: ("I", list(8 + np.cumsum([0, *map(len, blobs[:-1])]))), 325: ("I", list(map(len, blobs)))}
    codes, directory, extra = {"H": 3, "I": 4, "d": 12, "c": 2}, b"", b""
    after = at + 2 + 12 * len(tags) + 4
    for tag, (code, values) in sorted(tags.items()):
        value = struct.pack(order + code * len(values), *values)
        if len(value) > 4:
            directory += struct.pack(order + "HHII", tag, codes[code], len(values), after + len(extra))
            extra += value
        else:
            directory += struct.pack(order + "HHI", tag, codes[code], len(values)) + value.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    path.write_bytes(head + b"".join(blobs) + struct.pack(order + "H", len(tags)) + directory + struct.pack(order + "I", 0) + extra)
    return str(path)


def cataloged(spark, folder, rows):
    spark.createDataFrame(rows, raster.CATALOG).write.parquet(str(folder))
    return str(folder)


@pytest.fixture(scope="module")
def scenes(spark, tmp_path_factory):
    """Three scenes of 40 x 30 cells in tiles of 16, one cell in seven missing."""
    folder = f"file://{tmp_path_factory.mktemp('scenes')}"
    cells = spark.range(3 * 40 * 30).selectExpr("id % 3 AS s", "cast(id / 3 AS long) % 40 AS c", "cast(id / 120 AS long) AS r").filter("(c + r) % 7 <> 0")
    day = F.make_timestamp(F.lit(2024), F.col("s") + 1, F.lit(10), F.lit(0), F.lit(0), F.lit(0))
    pixels = cells.select(F.concat(F.lit("s"), "s").alias("scene_id"), day.alias("time"), (F.col("s") * 10.0).alias("cloud_cover"), (F.col("c") - 10 + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"), (F.col("c") * 100.0 + F.col("r")).alias("B04"), F.when(F.col("c") > 3, F.col("r") / 7).alias("B08"))
    catalog = raster.write_scenes(pixels, ["B04", "B08"], folder, 1.0, tile=16)
    return pixels, catalog, f"{folder}/catalog"


def test_files_give_the_pixels_back(spark, scenes):
    pixels, catalog, path = scenes
    found = raster.read_scenes(spark, path, ["B04", "B08"])
    assert found.exceptAll(pixels).count() == 0 and pixels.exceptAll(found).count() == 0
    assert {(r.scene_id, r.west, r.south, r.east, r.north) for r in catalog.collect()} == {(f"s{k}", -16.0, 0.0, 32.0, 32.0) for k in range(3)}
    assert raster.read_scenes(spark, path, ["B08"]).columns == ["scene_id", "time", "cloud_cover", "x", "y", "B08"]


def test_filters_leave_tiles_out(spark, scenes):
    pixels, _, path = scenes

    def planned(*filters):
        reader = raster.RasterReader({"path": path, "bands": "B04"})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark tests them again
        return reader.partitions()

    assert len(planned()) == 3 * 3 * 2
    assert len(planned(EqualTo(("scene_id",), "s1"))) == 6
    assert len(planned(GreaterThanOrEqual(("x",), 0.0), LessThan(("x",), 15.0), LessThanOrEqual(("y",), 10.0))) == 3
    assert len(planned(In(("scene_id",), ("s0", "s2")), LessThan(("cloud_cover",), 15.0))) == 6
    assert len(planned(GreaterThanOrEqual(("time",), datetime(2024, 2, 1)))) == 12
    assert planned(LessThan(("x",), -50.0)) == []
    near = (F.col("x") > 3) & (F.col("x") <= 9.5) & (F.col("y") < 7) & (F.col("time") >= F.lit("2024-02-01").cast("timestamp"))
    found = raster.read_scenes(spark, path, ["B04", "B08"]).filter(near)
    assert sorted(found.collect()) == sorted(pixels.filter(near).collect())
    plan = found._jdf.queryExecution().toString()
    assert found.rdd.getNumPartitions() == 2, plan  # a tile of two scenes, of 18
    assert raster.read_scenes(spark, path, ["B04"]).filter("x > 1000").count() == 0


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_files_of_other_writers(spark, tmp_path, order, predictor):
    fine = np.arange(20 * 25).reshape(20, 25) % 300
    coarse = np.arange(10 * 13).reshape(10, 13) * 1.5
    a = tiff(tmp_path / "a.tif", fine, 16, 10.0, 500.0, 900.0, order, "u2", predictor, nodata=7)
    b = tiff(tmp_path / "b.tif", coarse, 16, 20.0, 500.0, 900.0, order, "f4", compression=1)
    path = cataloged(spark, tmp_path / "catalog", [("one", datetime(2024, 1, 1), 3.0, 500.0, 700.0, 750.0, 900.0, {"B04": a, "B11": b}), ("none", datetime(2024, 1, 1), 3.0, 500.0, 700.0, 750.0, 900.0, {}), ("null", None, None, 500.0, 700.0, 750.0, 900.0, {"B11": b})])
    found = raster.read_scenes(spark, path, ["B04", "B11", "B99"]).collect()
    one = {(r.x, r.y): (r.B04, r.B11, r.B99) for r in found if r.scene_id == "one"}
    expected = {(505.0 + 10 * c, 895.0 - 10 * r): (None if fine[r, c] == 7 else float(fine[r, c]), float(coarse[r // 2, c // 2]), None) for r in range(20) for c in range(25)}
    assert one == expected
    assert sum(r.scene_id == "null" and r.time is None and r.B04 is None for r in found) == 130


def test_what_is_no_tiled_raster_raises(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"not a raster file")
    with pytest.raises(ValueError, match="no TIFF"):
        raster.grid_of(str(tmp_path / "x.tif"))
    path = tiff(tmp_path / "y.tif", np.zeros((4, 4)), 16, 1.0, 0.0, 4.0, compression=5)
    with pytest.raises(ValueError, match="compression 5"):
        raster.grid_of(path)
    with pytest.raises(Exception, match="bands"):
        spark.read.format("rasters").option("path", "x").load()
