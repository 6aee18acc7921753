"""Zipped shapefiles and KML, a task for each layer of an archive.

An archive's directory stands at its end: it alone is read to plan the tasks. A layer's members are then decompressed as streams, shapes and attribute rows side by side, so neither an archive nor a member is ever held whole, whatever its size.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from furrow.sources.ranges import file_of

FEATURE = "props map<string,string>, geometry_type string, coordinates array<array<double>>"
#: Features handed on at a time.
AT_A_TIME = 2_000

# Fixed values of shapefiles: the number they begin with, the length of their head, and kinds of shapes. With Z or with M a kind's number is 10 or 20 more, and its further numbers come after the plane's.
_MAGIC, _HEAD = 9994, 100
_KINDS = {0: None, 1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
_MORE = (11, 13, 15, 18, 21, 23, 25, 28)

Feature = tuple[dict[str, str], str | None, list[list[float]]]


class UnknownShape(Exception):
    """A shapefile's record has a type that isn't read."""


def _layers(archive: zipfile.ZipFile) -> list[tuple[str, str, str | None]]:
    """(kind, member, attribute table) of all shapefiles, and where there are none of the first KML."""
    names = archive.namelist()
    lower = {n.lower(): n for n in reversed(names)}
    shapes = []
    for name in names:
        if name.lower().endswith(".shp"):
            with archive.open(name) as f:
                begin = f.read(4)
            if len(begin) == 4 and struct.unpack(">i", begin)[0] == _MAGIC:
                shapes.append(("shp", name, lower.get(f"{name[:-4].lower()}.dbf")))
    kml = next((n for n in names if n.lower().endswith(".kml")), None)
    return shapes or ([("kml", kml, None)] if kml else [])


def _planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            system, place = file_of(path)
            with system.open_input_file(place) as f, zipfile.ZipFile(f) as archive:
                yield pd.DataFrame([(path, *layer) for layer in _layers(archive)], columns=["path", "kind", "member", "attributes"])


def _exactly(f: IO[bytes], n: int, name: str) -> bytes:
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError(f"{name} ends within a record")
    return raw


def shapes(f: IO[bytes], name: str) -> Iterator[tuple[str | None, list[list[float]]]]:
    """Kind and points of each record: 8 bytes of head, the type, then numbers."""
    f.read(_HEAD)
    while len(head := f.read(8)) == 8:
        body = _exactly(f, 2 * struct.unpack(">i", head[4:])[0], name)
        shape = struct.unpack("<i", body[:4])[0]
        shape = shape % 10 if shape in _MORE else shape
        if shape not in _KINDS:
            raise UnknownShape(f"{name}: shape type {shape}")
        values: tuple[float, ...] = ()
        if shape == 1:
            values = struct.unpack("<2d", body[4:20])
        elif shape in (3, 5):
            parts, count = struct.unpack("<2i", body[36:44])
            values = struct.unpack_from(f"<{2 * count}d", body, 44 + 4 * parts)
        elif shape == 8:
            values = struct.unpack_from(f"<{2 * struct.unpack('<i', body[36:40])[0]}d", body, 40)
        yield _KINDS[shape], [list(p) for p in zip(values[::2], values[1::2], strict=True)]


def attribute_rows(f: IO[bytes]) -> Iterator[dict[str, str]]:
    """Rows of fixed width after a head with their number and sizes and 32 bytes for each field."""
    count, head, width = struct.unpack("<IHH", f.read(32)[4:12])
    fields = f.read(head - 32)
    named = [(fields[k : k + 11].split(b"\0")[0].decode(), fields[k + 16]) for k in range(0, len(fields) - 1, 32) if fields[k] != 0x0D]
    for _ in range(count):
        row = f.read(width)
        if len(row) < width:
            return
        at, found = 1, {}
        for name, size in named:
            found[name] = row[at : at + size].decode("utf-8", "replace").strip()
            at += size
        yield found


def placemarks(f: IO[bytes]) -> Iterator[Feature]:
    """Placemarks as they end; what has been read is let go."""
    above: list[ET.Element] = []
    for event, element in ET.iterparse(f, events=("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag.rpartition("}")[2] != "Placemark":
            continue
        props: dict[str, str] = {}
        kind, points = None, []
        for part in element.iter():
            tag = part.tag.rpartition("}")[2]
            if tag in ("name", "description") and part.text:
                props[tag] = part.text
            elif tag in ("Point", "LineString", "Polygon") and kind is None:
                kind = tag
            elif tag == "coordinates" and not points:
                points = [[float(v) for v in p.split(",")[:2]] for p in (part.text or "").split()]
        yield props, kind, points
        for parent in above:
            parent.clear()


def _of_layer(archive: zipfile.ZipFile, kind: str, member: str, attributes: str | None) -> Iterator[Feature]:
    if kind == "kml":
        with archive.open(member) as f:
            yield from placemarks(f)
        return
    with archive.open(member) as f:
        table = archive.open(attributes) if attributes else None
        rows = attribute_rows(table) if table else iter(())
        for shape, points in shapes(f, member):
            yield next(rows, {}), shape, points
        if table:
            table.close()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            system, place = file_of(r.path)
            with system.open_input_file(place) as f, zipfile.ZipFile(f) as archive:
                held: list[Feature] = []
                for feature in _of_layer(archive, r.kind, r.member, r.attributes):
                    held.append(feature)
                    if len(held) == AT_A_TIME:
                        yield pd.DataFrame(held, columns=["props", "geometry_type", "coordinates"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["props", "geometry_type", "coordinates"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The features of all shapefiles of the archives; of an archive without one, those of its first KML. A record that ends early and a shape that isn't known raise errors."""
    files = spark.read.format("binaryFile").load(path).select("path")
    plan = files.repartition(max(1, files.count()), "path").mapInPandas(_planned, "path string, kind string, member string, attributes string").toPandas()  # a row for each layer
    if not len(plan):
        return spark.createDataFrame([], FEATURE)
    layers = spark.createDataFrame(plan, "path string, kind string, member string, attributes string")
    return layers.repartitionByRange(len(plan), "path", "member").mapInPandas(_read, FEATURE)
