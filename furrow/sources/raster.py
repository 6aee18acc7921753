"""Tiled raster files (GeoTIFF, one band a file) as a Python data source, and their writer.

A catalog table names scenes: id, time, cloud cover, box, and a file for each band. The source plans a partition for each tile of a scene's grid, from the catalog and the files' directories alone; filters on
scene, time, cloud cover and x, y reach that plan, so tiles outside are never read. Spark tests the filters again on the rows, so pruning by whole tiles loses nothing.
Bands of a coarser grid are read at the nearest cell of theirs, as in stacks of bands of one resolution. Files are reached by Arrow's file systems, by byte ranges.

Register with spark.dataSource.register(RasterSource), or use read_scenes, which also turns Spark's filter push-down for Python sources on.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

TILE = 256
_MOMENT = pa.timestamp("us", tz="UTC")
CATALOG = "scene_id string, time timestamp, cloud_cover double, west double, south double, east double, north double, assets map<string,string>"
_SCENE = "scene_id string, time timestamp, cloud_cover double, x double, y double"

# Fixed values of the TIFF and GeoTIFF formats.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _SAMPLES, _PREDICTOR = 256, 257, 258, 259, 262, 277, 317
_TILE_WIDTH, _TILE_HEIGHT, _OFFSETS, _COUNTS, _FORMAT, _SCALE, _TIEPOINT, _NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
_KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_STORED, _DEFLATE, _OLD_DEFLATE = 1, 8, 32946


@dataclass(frozen=True)
class Grid:
    """A raster's size, cell size, north-west corner and tiles."""

    width: int
    height: int
    step_x: float
    step_y: float
    west: float
    north: float
    tile_width: int
    tile_height: int
    dtype: str
    compression: int
    predictor: int
    nodata: float | None
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def tiles_across(self) -> int:
        return -(-self.width // self.tile_width)

    def box(self, tile: int) -> tuple[int, int, int, int]:
        """First and last-but-one column and row of a tile."""
        row, column = divmod(tile, self.tiles_across)
        left, top = column * self.tile_width, row * self.tile_height
        return left, min(left + self.tile_width, self.width), top, min(top + self.tile_height, self.height)

    def xs(self, first: int, last: int) -> np.ndarray:
        """Middles of columns."""
        return self.west + (np.arange(first, last) + 0.5) * self.step_x

    def ys(self, first: int, last: int) -> np.ndarray:
        return self.north - (np.arange(first, last) + 0.5) * self.step_y


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """`file:/x` as Spark writes it, for Arrow."""
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


@lru_cache(maxsize=1024)
def grid_of(path: str) -> Grid:
    """A file's directory; ValueError where it isn't a tiled one-band raster with its place."""
    system, place = _file(_uri(path))
    with system.open_input_file(place) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        big = order is not None and struct.unpack(order + "H", head[2:4])[0] == 43
        if order is None or not big and struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{path} is no TIFF file")
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        n = struct.unpack(order + ("Q" if big else "H"), f.read_at(8 if big else 2, at))[0]
        size, inline = (20, 8) if big else (12, 4)
        raw, tags = f.read_at(n * size, at + (8 if big else 2)), {}
        for k in range(n):
            tag, kind, count = struct.unpack(order + ("HHQ" if big else "HHI"), raw[k * size : (k + 1) * size - inline])
            code = _KINDS.get(kind)
            if code is None:
                continue
            long = struct.calcsize("<" + code) * count
            value = raw[(k + 1) * size - inline : (k + 1) * size]
            if long > inline:
                value = f.read_at(long, struct.unpack(order + ("Q" if big else "I"), value)[0])
            tags[tag] = value[:long] if code == "c" else struct.unpack(order + code * count, value[:long])
    missing = [t for t in (_WIDTH, _HEIGHT, _TILE_WIDTH, _TILE_HEIGHT, _OFFSETS, _COUNTS, _SCALE, _TIEPOINT) if t not in tags]
    if missing or tags.get(_SAMPLES, (1,))[0] != 1:
        raise ValueError(f"{path} is no tiled raster of one band with its place (tags {missing} are missing)")
    compression, predictor = tags.get(_COMPRESSION, (1,))[0], tags.get(_PREDICTOR, (1,))[0]
    if compression not in (_STORED, _DEFLATE, _OLD_DEFLATE) or predictor not in (1, 2):
        raise ValueError(f"{path} has compression {compression} and predictor {predictor}; known are stored and deflated tiles, plain or differenced")
    dtype = f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(_FORMAT, (1,))[0]] }{tags.get(_BITS, (1,))[0] // 8}"
    column, row, _, x, y, _ = tags[_TIEPOINT][:6]
    step_x, step_y = tags[_SCALE][:2]
    nodata = float(tags[_NODATA].rstrip(b"\0 ").decode()) if _NODATA in tags else None
    return Grid(
        tags[_WIDTH][0], tags[_HEIGHT][0], step_x, step_y, x - column * step_x, y + row * step_y, tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0], dtype, compression, predictor, nodata, tuple(tags[_OFFSETS]), tuple(tags[_COUNTS])
    )


def read_tile(path: str, grid: Grid, tile: int) -> np.ndarray:
    """A tile's cells as doubles, whole to its edges; nan where there is no data. A tile of no bytes is empty."""
    shape = (grid.tile_height, grid.tile_width)
    if not grid.counts[tile]:
        return np.full(shape, np.nan)
    system, place = _file(_uri(path))
    with system.open_input_file(place) as f:
        raw = f.read_at(grid.counts[tile], grid.offsets[tile])
    cells = np.frombuffer(raw if grid.compression == _STORED else zlib.decompress(raw), grid.dtype).reshape(shape)
    if grid.predictor == 2:
        cells = np.cumsum(cells, axis=1, dtype=cells.dtype)
    values = cells.astype(np.float64)
    return values if grid.nodata is None else np.where(values == grid.nodata, np.nan, values)


def _nearest(path: str, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The cells of a file nearest to the given columns and rows; nan outside it."""
    grid = grid_of(path)
    columns, rows = np.floor((xs - grid.west) / grid.step_x).astype(int), np.floor((grid.north - ys) / grid.step_y).astype(int)
    out = np.full((len(ys), len(xs)), np.nan)
    in_x, in_y = (columns >= 0) & (columns < grid.width), (rows >= 0) & (rows < grid.height)
    for down in np.unique(rows[in_y] // grid.tile_height):
        for across in np.unique(columns[in_x] // grid.tile_width):
            a, b = np.flatnonzero(in_y & (rows // grid.tile_height == down)), np.flatnonzero(in_x & (columns // grid.tile_width == across))
            cells = read_tile(path, grid, int(down * grid.tiles_across + across))
            out[np.ix_(a, b)] = cells[np.ix_(rows[a] % grid.tile_height, columns[b] % grid.tile_width)]
    return out


@dataclass
class _Tile(InputPartition):
    scene_id: str
    time: datetime
    cloud_cover: float
    files: tuple[str | None, ...]
    tile: int

    def __hash__(self) -> int:
        return hash((self.scene_id, self.tile))


class RasterSource(DataSource):
    """Options: path (the catalog table) and bands (their names, with commas). Rows: scene_id, time, cloud_cover, x, y and a column for each band, null without data; a cell that has no band at all has no row."""

    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> str:
        return _SCENE + "".join(f", `{b}` double" for b in _bands(self.options))

    def reader(self, schema: StructType) -> DataSourceReader:
        return RasterReader(dict(self.options))


def _bands(options: dict[str, str]) -> list[str]:
    found = [b.strip() for b in options.get("bands", "").split(",") if b.strip()]
    if not found:
        raise ValueError("the option bands must name bands")
    return found


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bands = options["path"], _bands(options)
        self.of_scene: pc.Expression | None = None
        self.box = {"x": [-np.inf, np.inf], "y": [-np.inf, np.inf]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can to leave scenes and tiles out; Spark tests all of them again."""
        for f in filters:
            self._take(f)
            yield f

    def _take(self, f: Filter) -> None:
        signs = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column in self.box and type(f) in signs:
            low, high = self.box[column]
            self.box[column] = [max(low, f.value) if signs[type(f)] in (">", ">=", "==") else low, min(high, f.value) if signs[type(f)] in ("<", "<=", "==") else high]
        elif column in ("scene_id", "time", "cloud_cover") and (type(f) in signs or isinstance(f, In)):
            field, values = pc.field(column), [v.replace(tzinfo=v.tzinfo or UTC) if isinstance(v, datetime) else v for v in (f.value if isinstance(f, In) else [f.value])]
            field = field.cast(_MOMENT) if column == "time" else field
            if isinstance(f, In):
                test = field.isin(pa.array(values, _MOMENT) if column == "time" else values)
            else:
                test = {"==": field.__eq__, ">": field.__gt__, ">=": field.__ge__, "<": field.__lt__, "<=": field.__le__}[signs[type(f)]](pc.scalar(values[0]))
            self.of_scene = test if self.of_scene is None else self.of_scene & test

    def partitions(self) -> list[_Tile]:
        system, place = _file(_uri(self.path))
        catalog = pads.dataset(place, filesystem=system, format="parquet")
        (west, east), (south, north) = self.box["x"], self.box["y"]
        touches = (pc.field("west") <= east) & (pc.field("east") >= west) & (pc.field("south") <= north) & (pc.field("north") >= south)
        found = catalog.to_table(["scene_id", "time", "cloud_cover", "assets"], filter=touches if self.of_scene is None else touches & self.of_scene)
        found = found.set_column(1, "time", found["time"].cast(_MOMENT))
        tiles = []
        for row in found.to_pylist():
            assets = dict(row["assets"] or [])
            files = tuple(assets.get(b) for b in self.bands)
            grids = [(grid_of(p).step_x, p) for p in files if p]
            if not grids:
                continue
            grid = grid_of(min(grids)[1])  # the finest band's
            for tile in range(len(grid.offsets)):
                left, right, top, bottom = grid.box(tile)
                xs, ys = grid.xs(left, right), grid.ys(top, bottom)
                if xs[0] <= east and xs[-1] >= west and ys[0] >= south and ys[-1] <= north:
                    tiles.append(_Tile(row["scene_id"], row["time"], row["cloud_cover"], files, tile))
        return tiles

    def read(self, partition: _Tile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is left to read
            return
        finest = min((grid_of(p).step_x, p) for p in partition.files if p)[1]
        grid = grid_of(finest)
        left, right, top, bottom = grid.box(partition.tile)
        xs, ys = grid.xs(left, right), grid.ys(top, bottom)
        # Columns and rows that the filters leave out go before their cells become rows.
        xs, ys = (v[(v >= self.box[n][0]) & (v <= self.box[n][1])] for v, n in ((xs, "x"), (ys, "y")))
        values = [_nearest(p, xs, ys).ravel() if p else np.full(len(xs) * len(ys), np.nan) for p in partition.files]
        some = ~np.all(np.isnan(values), axis=0)
        n = int(some.sum())
        if not n:
            return
        time = pa.array([partition.time], _MOMENT)
        columns = [pa.array([partition.scene_id] * n, pa.string()), time.take(pa.array(np.zeros(n, np.int64))), pa.array([partition.cloud_cover] * n, pa.float64())]
        columns += [pa.array(np.tile(xs, len(ys))[some]), pa.array(np.repeat(ys, len(xs))[some]), *[pa.array(v[some], from_pandas=True) for v in values]]
        yield pa.RecordBatch.from_arrays(columns, ["scene_id", "time", "cloud_cover", "x", "y", *self.bands])


def read_scenes(spark: SparkSession, catalog: str, bands: list[str]) -> DataFrame:
    """Pixels of a catalog's scenes, with a column for each band."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    return spark.read.format("rasters").option("path", catalog).option("bands", ",".join(bands)).load()


def _encoded(tiles: dict[int, bytes], across: int, down: int, size: int, step: float, west: float, north: float) -> bytes:
    """A raster file of deflated tiles of doubles; tiles that aren't given have no bytes."""
    packed = [tiles.get(k, b"") for k in range(across * down)]
    entries: list[tuple[int, int, int, bytes]] = []

    def entry(tag: int, kind: int, *values: float) -> None:
        entries.append((tag, kind, len(values), struct.pack("<" + _KINDS[kind] * len(values), *values)))

    for tag, value in ((_WIDTH, across * size), (_HEIGHT, down * size)):
        entry(tag, 4, value)
    for tag, value in ((_BITS, 64), (_COMPRESSION, _DEFLATE), (_PHOTOMETRIC, 1), (_SAMPLES, 1), (_TILE_WIDTH, size), (_TILE_HEIGHT, size), (_FORMAT, 3)):
        entry(tag, 3, value)
    entry(_SCALE, 12, step, step, 0.0)
    entry(_TIEPOINT, 12, 0.0, 0.0, 0.0, west, north, 0.0)
    head = 16 + 8 + 20 * (len(entries) + 2) + 8
    start = head + sum(len(e[3]) for e in entries if len(e[3]) > 8) + 16 * len(packed)
    ends = np.cumsum([start, *map(len, packed)]).tolist()
    entry(_OFFSETS, 16, *ends[:-1])
    entry(_COUNTS, 16, *map(len, packed))
    directory, values = b"", b""
    for tag, kind, count, value in sorted(entries):
        directory += struct.pack("<HHQ", tag, kind, count) + (value.ljust(8, b"\0") if len(value) <= 8 else struct.pack("<Q", head + len(values)))
        values += value if len(value) > 8 else b""
    before = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(entries)) + directory + struct.pack("<Q", 0) + values
    return before.ljust(start, b"\0") + b"".join(packed)


def write_scenes(pixels: DataFrame, bands: list[str], folder: str, step: float, tile: int = TILE) -> DataFrame:
    """Writes pixels (scene_id, time, cloud_cover, x, y and bands; middles of cells of the given size) as a file for each scene and band, and returns the catalog of them, which is written as well.

    Cells meet by tile, then the deflated tiles by scene and band. Files have the scene's and band's names and are put in place whole, so a task that runs again gives the same one; of a cell that comes twice one value stays.
    """
    size = step * tile

    def tiles(keys: tuple, table: pa.Table) -> pa.Table:
        down, across = keys[1].as_py(), keys[2].as_py()
        column, row = (np.clip(np.floor(v), 0, tile - 1).astype(int) for v in ((table["x"].to_numpy() - across * size) / step, (-down * size - table["y"].to_numpy()) / step))
        blobs = []
        for band in bands:
            cells = np.full((tile, tile), np.nan)
            cells[row, column] = table[band].to_numpy()
            blobs.append(zlib.compress(cells.astype("<f8").tobytes(), 1))
        n = len(bands)
        fixed = [pa.array([keys[0].as_py()] * n, pa.string()), table["time"].slice(0, 1).combine_chunks().take(pa.array([0] * n)), pa.array([table["cloud_cover"][0].as_py()] * n, pa.float64())]
        return pa.table([*fixed, pa.array([down] * n), pa.array([across] * n), pa.array(bands), pa.array(blobs, pa.binary())], ["scene_id", "time", "cloud_cover", "down", "across", "band", "tile"])

    def files(keys: tuple, table: pa.Table) -> pa.Table:
        system, place = _file(_uri(folder))
        down, across = table["down"].to_numpy(), table["across"].to_numpy()
        top, left, wide, high = int(down.min()), int(across.min()), int(np.ptp(across)) + 1, int(np.ptp(down)) + 1
        held = dict(zip(((down - top) * wide + across - left).tolist(), table["tile"].to_pylist(), strict=True))
        name = f"{keys[0].as_py()}-{keys[1].as_py()}.tif"
        system.create_dir(place)
        with system.open_output_stream(other := f"{place}/.{name}-{uuid.uuid4().hex}") as f:
            f.write(_encoded(held, wide, high, tile, step, left * size, -top * size))
        system.move(other, f"{place}/{name}")
        box = {"west": left * size, "south": -(top + high) * size, "east": (left + wide) * size, "north": -top * size}
        first = table.slice(0, 1).select(["scene_id", "time", "cloud_cover", "band"])
        for n, v in box.items():
            first = first.append_column(n, pa.array([v], pa.float64()))
        return first.append_column("file", pa.array([f"{folder}/{name}"]))

    numbered = pixels.select("scene_id", F.col("time").cast("timestamp").alias("time"), F.col("cloud_cover").cast("double").alias("cloud_cover"), "x", "y", *[F.col(b).cast("double").alias(b) for b in bands])
    numbered = numbered.withColumns({"down": F.floor(-F.col("y") / size).cast("long"), "across": F.floor(F.col("x") / size).cast("long")})
    held = numbered.groupBy("scene_id", "down", "across").applyInArrow(tiles, "scene_id string, time timestamp, cloud_cover double, down long, across long, band string, tile binary")
    written = held.groupBy("scene_id", "band").applyInArrow(files, "scene_id string, time timestamp, cloud_cover double, band string, west double, south double, east double, north double, file string")
    boxes = [F.first(n).alias(n) for n in ("time", "cloud_cover", "west", "south", "east", "north")]
    catalog = written.groupBy("scene_id").agg(*boxes, F.map_from_entries(F.collect_list(F.struct("band", "file"))).alias("assets"))
    catalog.write.mode("overwrite").parquet(f"{folder}/catalog")
    return pixels.sparkSession.read.schema(CATALOG).parquet(f"{folder}/catalog")
