"""Small typed tables, documents of entries, and stored settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from furrow.functions import js


@dataclass(frozen=True)
class TableDefinition:
    """A table's key, and its columns as (name, Spark type, required, allowed values)."""

    name: str
    key: str
    columns: tuple[tuple[str, str, bool, tuple[str, ...]], ...]

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t, _, _ in self.columns)


# The external tables' columns.
LOCATION_MASTER = TableDefinition(
    "location_master",
    "farm_id",
    (
        ("farm_id", "string", True, ()),
        ("farm_name", "string", True, ()),
        ("crop_type", "string", True, ("Wheat", "Corn", "Tomato", "Potato")),
        ("area_ha", "double", True, ()),
        ("planted_on", "date", False, ()),
        ("status", "string", True, ("Active", "Inactive")),
    ),
)
IRRIGATION_LOG = TableDefinition(
    "irrigation_log",
    "log_id",
    (
        ("log_id", "string", True, ()),
        ("farm_id", "string", True, ()),
        ("irrigation_date", "date", True, ()),
        ("amount_mm", "double", True, ()),
        ("method", "string", True, ("Drip", "Sprinkler", "Flood")),
        ("notes", "string", False, ()),
    ),
)
TABLES = {t.name: t for t in (LOCATION_MASTER, IRRIGATION_LOG)}


def definition(name: str) -> TableDefinition:
    """An external table's definition by its name in any case."""
    try:
        return TABLES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"no table {name!r}") from None


def external_table(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """Rows of texts as an external table, registered as a view under its name."""
    known = definition(name)
    texts = spark.createDataFrame(rows, ", ".join(f"{n} string" for n, *_ in known.columns))
    made = texts.select(*[F.col(n).try_cast(t).alias(n) for n, t, _, _ in known.columns])
    made.createOrReplaceTempView(known.name)
    return made


def row_errors(known: TableDefinition) -> Column:
    """What is wrong with a row of texts: missing values, types, and values that aren't allowed."""
    errors = []
    for name, kind, required, allowed in known.columns:
        value = js.nonblank(F.col(name))
        error = F.when(value.isNull(), F.lit(f"{name} is required" if required else None).cast("string"))
        error = error.when(value.try_cast(kind).isNull(), f"{name} is no {kind}")
        errors.append(error.when(~value.isin(*allowed), f"{name} is not allowed") if allowed else error)
    return F.array_compact(F.array(*errors))


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a JSON array in a file; none where the file is missing or holds anything else."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return whole.filter("trim(value) LIKE '[%'").select(F.inline(F.from_json("value", f"array<struct<{_fields(schema)}>>")))


def _fields(schema: str) -> str:
    return DataType.fromDDL(schema).simpleString()[len("struct<") : -1]


LAYERS = "id string, name string, type string, visible boolean, created_at string, fields array<string>, features array<struct<geometry_type:string,coordinates:array<array<double>>,props:map<string,string>>>"


def save_layers(layers: DataFrame, path: str) -> None:
    """The saved layers as a new version in the folder; older versions stay until they are removed."""
    layers.write.parquet(f"{path}/version={1 + max(_versions(layers.sparkSession, path), default=-1)}")


def load_layers(spark: SparkSession, path: str, schema: str = LAYERS) -> DataFrame:
    """The newest saved layers; none where nothing was saved."""
    versions = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={max(versions)}") if versions else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that were written to their end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("version=")]
    return [int(p.getName().split("=")[1]) for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def append_capped(base: DataFrame, new: DataFrame, cap: int, order: list[str], path: str, by: list[str] = ()) -> None:
    """Writes the `cap` newest rows of the log with the new ones as its next version (see save_layers): what was there is whole until that is."""
    from furrow.operators.catalog import newest

    newest(base.unionByName(new), cap, order, by).write.parquet(f"{path}/version={1 + max(_versions(base.sparkSession, path), default=-1)}")


def setting(text: Column, schema: str, fallback: Column) -> Column:
    """A stored setting from JSON, or the fallback where it is missing or malformed."""
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)), fallback)
