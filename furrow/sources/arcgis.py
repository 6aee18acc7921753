"""Feature services as a Python data source.

Filters and wanted fields reach the service: what its `where` can say of a filter goes there, escaped, and Spark tests every filter again on the rows, as a service may compare texts more loosely. The service is read in
ranges of its object ids, a partition each, and within a range by key: the next page begins after the last object id, in their order, so rows that come or go meanwhile shift nothing.
Recorded answers (a file with one, or a folder of text files with one a line) can be read in place of a service. Register with spark.dataSource.register(ArcGisSource), or use read_service.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlencode
from urllib.request import urlopen

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import DataType, StructType

from furrow.operators.catalog import natural_key

PAGE, MAX_PAGES = 2000, 50
KEY = "OBJECTID"


class ArcGisSource(DataSource):
    """Options: url or path; page, pages, key, fields, contains, token. Rows: x and y of a point or null, and the features' attributes: as JSON text, or as columns where `fields` names and types them.

    `contains` is a JSON object of fields and terms that they must hold, as a search box asks for them. A service with over MAX_PAGES pages raises ValueError unless `pages` allows more, so nothing is left out unsaid.
    """

    @classmethod
    def name(cls) -> str:
        return "arcgis"

    def schema(self) -> str:
        return f"{self.options.get('fields', 'attributes string')}, x double, y double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Recorded(dict(self.options), schema) if "path" in self.options else _Reader(dict(self.options), schema)


def read_service(spark: SparkSession, url: str, fields: str, **options: str) -> DataFrame:
    """The named and typed fields, x and y of a service's features; filters on them reach the service."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArcGisSource)
    return spark.read.format("arcgis").options(url=url, fields=fields, **options).load()


def suggestions(spark: SparkSession, url: str, field: str, term: str, fields: str, **options: str) -> DataFrame:
    """Features whose field holds the term, by the service's own search: wildcards in the term count as nothing."""
    return read_service(spark, url, fields, contains=json.dumps({field: term}), **options)


def escaped_term(term: str | None) -> str:
    """A search term for LIKE: without wildcards, quotes doubled."""
    return (term or "").replace("%", "").replace("_", "").replace("'", "''")


def _quoted(value: object) -> str | None:
    if isinstance(value, bool) or not isinstance(value, str | int | float):
        return None
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def clause(f: Filter, fields: set[str]) -> str | None:
    """What a `where` can say of a filter without leaving out a row that passes it; None where that is nothing.

    A wildcard in a text that a field must hold stands for itself among others. Orders of texts differ from service to service, so texts are compared for equality alone.
    """
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in fields:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNull | IsNotNull):
        return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL"
    if isinstance(f, In):
        values = [_quoted(v) for v in f.value if v is not None]
        return f"{name} IN ({', '.join(values)})" if values and None not in values else None
    if isinstance(f, StringContains | StringStartsWith | StringEndsWith):
        text = f.value.replace("%", "_").replace("'", "''")
        return f"{name} LIKE '{'' if isinstance(f, StringStartsWith) else '%'}{text}{'' if isinstance(f, StringEndsWith) else '%'}'"
    sign = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}.get(type(f))
    value = _quoted(f.value) if sign else None
    return None if value is None or sign != "=" and isinstance(f.value, str) else f"{name} {sign} {value}"


class _Range(InputPartition):
    """Object ids after `after`, up to `until` (None: to the end)."""

    def __init__(self, after: int, until: int | None):
        super().__init__(after)
        self.after, self.until = after, until


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.page, self.key = options, int(options.get("page", PAGE)), options.get("key", KEY)
        self.most = int(options.get("pages", MAX_PAGES))
        self.columns = [(f.name, f.dataType) for f in schema.fields[:-2]] if "fields" in options else None
        self.where = [f"{n} LIKE '%{escaped_term(t)}%'" for n, t in json.loads(options.get("contains", "{}")).items()]
        self.box = {"x": [-180.0, 180.0], "y": [-90.0, 90.0]}
        self.boxed = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        fields = {n for n, _ in self.columns or []}
        for f in filters:
            self._bound(f)
            said = clause(f, fields)
            if said:
                self.where.append(said)
            yield f

    def _bound(self, f: Filter) -> None:
        if type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute in (("x",), ("y",)):
            low, high = self.box[f.attribute[0]]
            self.boxed = True
            self.box[f.attribute[0]] = [low if type(f) in (LessThan, LessThanOrEqual) else max(low, f.value), high if type(f) in (GreaterThan, GreaterThanOrEqual) else min(high, f.value)]

    def _ask(self, keys: list[str], **asked: str) -> dict:
        (west, east), (south, north) = self.box["x"], self.box["y"]
        if self.boxed:
            asked |= {"geometry": f"{west},{south},{east},{north}", "geometryType": "esriGeometryEnvelope", "inSR": "4326", "spatialRel": "esriSpatialRelIntersects"}
        if "token" in self.options:
            asked["token"] = self.options["token"]
        where = " AND ".join(f"({c})" for c in [*self.where, *keys]) or "1=1"
        with urlopen(query_url(self.options["url"], where, **asked)) as answer:  # noqa: S310
            found = json.load(answer)
        if "error" in found:
            raise RuntimeError(f"the service answers {found['error']}")
        return found

    def partitions(self) -> list[_Range]:
        wanted = [{"statisticType": kind, "onStatisticField": self.key, "outStatisticFieldName": kind} for kind in ("min", "max", "count")]
        features = self._ask([], outStatistics=json.dumps(wanted)).get("features", [])
        found = {k.lower(): v for k, v in (features[0]["attributes"] if features else {}).items()}
        if not found.get("count"):
            return []
        low, high, pages = int(found["min"]), int(found["max"]), max(1, -(-int(found["count"]) // self.page))
        if pages > self.most:
            raise ValueError(f"the service has {pages} pages, more than the {self.most} allowed")
        edges = [low - 1 + (high - low + 1) * k // pages for k in range(pages)]
        return [_Range(a, b) for a, b in zip(edges, [*edges[1:], None], strict=True) if b is None or a < b]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # nothing passes the filters
            return
        names = "*" if self.columns is None else ",".join(dict.fromkeys([self.key, *(n for n, _ in self.columns)]))
        last = partition.after
        while True:
            keys = [f"{self.key} > {last}"] + ([f"{self.key} <= {partition.until}"] if partition.until is not None else [])
            answer = self._ask(keys, outFields=names, outSR="4326", orderByFields=self.key, resultRecordCount=str(self.page))
            features = answer.get("features", [])
            for feature in features:
                yield _row(feature, self.columns)
            if not features or len(features) < self.page and not answer.get("exceededTransferLimit"):
                return
            last = int(features[-1]["attributes"][self.key])


def _row(feature: dict, columns: list[tuple[str, DataType]] | None) -> tuple:
    attributes, geometry = feature.get("attributes") or {}, feature.get("geometry") or {}
    if columns is None:
        return json.dumps(attributes), geometry.get("x"), geometry.get("y")
    return (*[_typed(attributes.get(n), kind.simpleString()) for n, kind in columns], geometry.get("x"), geometry.get("y"))


def _typed(value: object, kind: str) -> object:
    """A value as its column has it; one that can't be read so is null."""
    if value is None:
        return None
    try:
        if kind == "string":
            return value if isinstance(value, str) else json.dumps(value)
        return float(value) if kind in ("double", "float") else bool(value) if kind == "boolean" else int(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def query_url(url: str, where: str = "1=1", **asked: str) -> str:
    return f"{url.split('?')[0].rstrip('/')}/query?{urlencode({'f': 'json', 'where': where, **asked})}"


class _Page(InputPartition):
    def __init__(self, file: str, offset: int, is_last: bool):
        super().__init__(offset)
        self.file, self.offset, self.is_last = file, offset, is_last


class _Recorded(DataSourceReader):
    """A file with one answer is read a page of features in a partition, a folder a file of answers in a partition."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.page = options["path"], int(options.get("page", PAGE))
        self.most = int(options.get("pages", MAX_PAGES))
        self.columns = [(f.name, f.dataType) for f in schema.fields[:-2]] if "fields" in options else None

    def partitions(self) -> list[_Page]:
        system, place = _file(self.path)
        if system.get_file_info(place).type == pafs.FileType.Directory:
            found = system.get_file_info(pafs.FileSelector(place))
            return [_Page(f.path, 0, True) for f in found if f.type == pafs.FileType.File and f.size and f.base_name[0] not in "._"]
        pages = max(1, -(-_count(self.path) // self.page))
        if pages > self.most:
            raise ValueError(f"the service has {pages} pages, more than the {self.most} allowed")
        return [_Page("", k * self.page, k == pages - 1) for k in range(pages)]

    def read(self, partition: _Page | None) -> Iterator[tuple]:
        if partition is None:
            return
        if partition.file:
            with _file(self.path)[0].open_input_stream(partition.file) as f:
                for line in f.read().splitlines():  # a file of Spark's writer
                    for feature in json.loads(line).get("features", []):
                        yield _row(feature, self.columns)
            return
        fetch, at, stop = _from_file(self.path), partition.offset, partition.offset + self.page
        while partition.is_last or at < stop:
            features = fetch(at, self.page if partition.is_last else stop - at)
            for feature in features:
                yield _row(feature, self.columns)
            at += len(features)
            if not features:
                return


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    path = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


@lru_cache(maxsize=4)
def _features(path: str, changed: object) -> list[dict]:
    """A file's features, parsed once for all its pages."""
    system, place = _file(path)
    with system.open_input_stream(place) as f:
        return json.loads(f.read())["features"]


def _all_features(path: str) -> list[dict]:
    system, place = _file(path)
    return _features(path, system.get_file_info(place).mtime_ns)


def _count(path: str) -> int:
    return len(_all_features(path))


def _from_file(path: str) -> Callable[[int, int], list[dict]]:
    return lambda offset, limit: _all_features(path)[offset : offset + limit]


def valve_options(features: DataFrame, field: str = "Valve_No") -> DataFrame:
    """A field's distinct values in natural order."""
    value = F.trim(F.get_json_object("attributes", f"$.{field}"))
    return features.select(value.alias("value")).filter("value <> ''").distinct().orderBy(natural_key(F.col("value")))


def discovered_layers(spark: SparkSession, path: str, url: str) -> DataFrame:
    """id, name, kind and url of a service's layers and tables that have a numeric id and a name."""
    whole = spark.read.text(path, wholetext=True)

    def part(kind: str) -> DataFrame:
        listed = F.from_json(F.get_json_object("value", f"$.{kind}"), "array<struct<id:int,name:string>>")
        return whole.select(F.lit(kind).alias("kind"), F.inline(listed))

    base: Column = F.lit(url.rstrip("/") + "/")
    return part("layers").unionByName(part("tables")).filter("id IS NOT NULL AND name <> ''").withColumn("url", F.concat(base, F.col("id").cast("string")))


LAYER_DEFINITION = "typeIdField string, types array<struct<id:string,name:string,domains:map<string,struct<codedValues:array<struct<code:string,name:string>>>>>>, fields array<struct<name:string,alias:string,type:string,editable:boolean,nullable:boolean,domain:struct<type:string,range:array<double>,codedValues:array<struct<code:string,name:string>>>>>"


SYMBOL = "struct<type:string,style:string,color:array<double>,size:double,width:double>"
RENDERER = f"struct<type:string,field1:string,field2:string,field3:string,field:string,symbol:{SYMBOL},defaultSymbol:{SYMBOL},defaultLabel:string,uniqueValueInfos:array<struct<value:string,label:string,symbol:{SYMBOL}>>,classBreakInfos:array<struct<classMaxValue:double,label:string,symbol:{SYMBOL}>>>"


def layer_definition(spark: SparkSession, path: str) -> DataFrame:
    """A layer's fields, domains and subtypes, and how it is drawn (drawingInfo.renderer)."""
    schema = f"{LAYER_DEFINITION}, drawingInfo struct<renderer:{RENDERER}>"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*")


def renderer_infos(definition: DataFrame) -> DataFrame:
    """A row for each class or value of the renderer, in order: place, label, value, largest and symbol, as styling.legend takes them."""
    drawn = definition.select("drawingInfo.renderer.*")
    none = F.lit(None)
    values = F.transform("uniqueValueInfos", lambda i: F.struct(i["label"].alias("label"), i["value"].alias("value"), none.cast("double").alias("largest"), i["symbol"].alias("symbol")))
    breaks = F.transform("classBreakInfos", lambda i: F.struct(i["label"].alias("label"), none.cast("string").alias("value"), i["classMaxValue"].alias("largest"), i["symbol"].alias("symbol")))
    return drawn.select(F.posexplode(F.coalesce(values, breaks)).alias("place", "i")).select("place", "i.*")


def coded_values(definition: DataFrame) -> DataFrame:
    """(field, code, name) of the fields' domains."""
    fields = definition.select(F.inline("fields")).filter("domain.codedValues IS NOT NULL")
    return fields.select(F.col("name").alias("field"), F.explode("domain.codedValues").alias("v")).select("field", "v.code", "v.name")
