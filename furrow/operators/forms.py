"""Entries, bindings and farm attributes of the data-entry forms, and the audit log.

Nested values are maps and arrays of the rows: a form's values are a map of sources to maps of fields to texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import js, text

# What an entry's kind may be, and the limits of its fields as (lowest, highest, whole).
ENTRY_FORM, ENTRY_KINDS = "EC", ("draft", "submitted")
LIMITS: dict[str, tuple[float | None, float | None, bool]] = {
    "pH_In": (0, 14, False), "pH_Out": (0, 14, False), "DripVolume_ml": (0, None, False), "Drain_Volume_ml": (0, None, False), "Qty_Of_Water_M3": (0, None, False), "Cycle": (1, None, True),
}
# A farm's attributes that forms take, and the names under which its place and its last edit go.
FARM_FIELDS = ("Farm_Code", "Farm_Name", "ZONE_ID", "Area_ha", "Structure_Type", "Country")
PROJECT_FIELDS = ("ProjectCode", "Project_Code")
PLACE_FIELDS, LATITUDE_FIELDS, LONGITUDE_FIELDS = ("Location", "LOCATION", "Farm_Location", "FarmLocation"), ("Latitude", "LATITUDE", "Lat", "LAT"), ("Longitude", "LONGITUDE", "Lon", "LON", "Lng", "LNG")
EDIT_FIELDS = ("Last_Update", "LAST_UPDATE", "last_edited_date", "edit_date")
EDIT_SOURCES = ("last_edited_date", "Last_Update", "LAST_UPDATE", "edit_date")

STATE = "struct<sourceIds:array<string>,selectedFieldsBySource:map<string,array<string>>,valuesBySource:map<string,map<string,string>>>"
BINDING = "struct<sourceIds:array<string>,selectedFieldsBySource:map<string,array<string>>,fieldConfigsBySource:map<string,array<struct<name:string,enabled:boolean,required:boolean>>>>"
ENTRY = f"formKey string, kind string, state {STATE}"


def entry_problems(entry: Column) -> Column:
    """What is wrong with an entry (a struct as ENTRY, null where the body had no object): all problems, none is an empty array."""
    form, kind, state = entry["formKey"], entry["kind"], entry["state"]
    return F.array_compact(
        F.array(
            F.when(form.isNull(), "formKey is required").when(form != ENTRY_FORM, f"formKey must be {ENTRY_FORM}"),
            F.when(kind.isNull(), "kind is required").when(~kind.isin(*ENTRY_KINDS), "kind must be draft or submitted"),
            *[F.when(state.isNull() | state[n].isNull(), f"state.{n} is required") for n in ("sourceIds", "selectedFieldsBySource", "valuesBySource")],
        )
    )


def accepted_entries(bodies: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(entries, rejected rows with `problems`) of JSON bodies; fields that aren't known are dropped."""
    parsed = bodies.withColumn("entry", F.from_json(column, ENTRY))
    checked = parsed.withColumn("problems", entry_problems(F.col("entry")))
    others = [c for c in bodies.columns if c != column]
    good = checked.filter(F.size("problems") == 0).select(*others, "entry.formKey", "entry.kind", "entry.state")
    return good, checked.filter(F.size("problems") > 0).select(*bodies.columns, "problems")


def _out_of_limits(values: Column, field: str, limits: tuple[float | None, float | None, bool]) -> Column:
    """The error of one field in any of the sources: that of the first value that has one. The messages are fixed values."""
    low, high, whole = limits
    candidates = F.transform(F.map_entries(values), lambda s: js.nonblank(F.try_element_at(s["value"], F.lit(field))))

    def error(raw: Column) -> Column:
        number = js.number(raw)
        out = F.when(number.isNull() | (F.abs(number) == float("inf")), f"{field} must be a number")
        if whole:
            out = out.when(number != F.floor(number), f"{field} must be an integer")
        if low is not None:
            out = out.when(number < low, f"{field} must be ≥ {low:g}")
        return out if high is None else out.when(number > high, f"{field} must be ≤ {high:g}")

    return F.get(F.array_compact(F.transform(F.array_compact(candidates), error)), 0)


def submit_errors(values: Column, configs: Column) -> Column:
    """Errors of a form that is to be submitted: its required and enabled fields that are blank, by name, then numbers outside LIMITS.

    values maps sources to maps of fields to texts; configs maps sources to arrays of (name, enabled, required).
    """

    def missing(source: Column) -> Column:
        asked = F.filter(source["value"], lambda c: F.coalesce(c["enabled"] & c["required"], F.lit(False)) & (F.coalesce(c["name"], F.lit("")) != ""))
        held = F.coalesce(F.try_element_at(values, source["key"]), F.create_map().cast("map<string,string>"))
        return F.transform(F.filter(asked, lambda c: js.nonblank(F.try_element_at(held, c["name"])).isNull()), lambda c: c["name"])

    required = F.flatten(F.transform(F.map_entries(configs), missing))
    return F.concat(required, F.array_compact(F.array(*[_out_of_limits(values, f, limits) for f, limits in LIMITS.items()])))


def binding(source_ids: Column, configs: Column) -> Column:
    """A form's saved settings: sources trimmed and not blank, their fields with names, all enabled, and the names alone."""
    ids = F.filter(F.transform(source_ids, lambda s: F.trim(s)), lambda s: F.coalesce(s, F.lit("")) != "")

    def fields(ident: Column) -> Column:
        named = F.filter(F.coalesce(F.try_element_at(configs, ident), F.array().cast("array<struct<name:string,required:boolean>>")), lambda c: js.nonblank(c["name"]).isNotNull())
        return F.transform(named, lambda c: F.struct(F.trim(c["name"]).alias("name"), F.lit(True).alias("enabled"), F.coalesce(c["required"], F.lit(False)).alias("required")))

    made = F.map_from_entries(F.transform(F.array_distinct(ids), lambda i: F.struct(i, fields(i))))
    return F.struct(ids.alias("sourceIds"), F.transform_values(made, lambda _, f: F.transform(f, lambda c: c["name"])).alias("selectedFieldsBySource"), made.alias("fieldConfigsBySource"))


def save_bindings(base: DataFrame, drafts: DataFrame) -> DataFrame:
    """base(form_key, binding, management_layer) with the forms of drafts(form_key, source_ids, configs), one row a form, in new versions; a form's management layer stays."""
    made = drafts.select(F.col("form_key").alias("new_key"), binding(F.col("source_ids"), F.col("configs")).alias("new_binding"))
    joined = base.join(made, F.col("form_key") == F.col("new_key"), "full")
    return joined.select(F.coalesce("new_key", "form_key").alias("form_key"), F.coalesce("new_binding", "binding").alias("binding"), "management_layer")


def farm_attributes(attributes: Column, longitude: Column | None = None, latitude: Column | None = None) -> Column:
    """All that a farm's attributes (a map of texts) and place give a form, as a map; trimmed, missing ones as empty texts, and without a place or an edit date none of their names.

    An edit date is a number of milliseconds or a text that begins with a date.
    """

    def held(name: str) -> Column:
        return F.try_element_at(attributes, F.lit(name))

    entries = [(f, F.trim(F.coalesce(held(f), F.lit("")))) for f in FARM_FIELDS]
    project = F.trim(F.coalesce(F.nullif(held("ProjectCode"), F.lit("")), held("Project_Code"), F.lit("")))
    entries += [(f, project) for f in PROJECT_FIELDS]
    if longitude is not None and latitude is not None:
        lat, lon = js.fixed(latitude, 6), js.fixed(longitude, 6)
        known = latitude.isNotNull() & longitude.isNotNull()
        entries += [(f, F.when(known, F.concat(lat, F.lit(", "), lon))) for f in PLACE_FIELDS]
        entries += [(f, F.when(known, v)) for fields, v in ((LATITUDE_FIELDS, lat), (LONGITUDE_FIELDS, lon)) for f in fields]
    edited = F.coalesce(*[held(f) for f in EDIT_SOURCES])
    date = F.coalesce(text.ymd(F.regexp_extract(F.trim(edited), r"^(-?\d+)$", 1).try_cast("long")), F.nullif(F.regexp_extract(edited, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    entries += [(f, date) for f in EDIT_FIELDS]
    return F.map_filter(F.create_map(*[x for f, v in entries for x in (F.lit(f), v)]), lambda _, v: v.isNotNull())


def filled(values: Column, updates: Column) -> Column:
    """A form's values with the updates put over them."""
    return F.map_concat(F.map_filter(values, lambda k, _: ~F.map_contains_key(updates, k)), updates)


def cleared(enabled: Column, fields: tuple[str, ...]) -> Column:
    """The updates that blank those of the fields that are enabled."""
    return F.map_from_entries(F.transform(F.array_intersect(F.array(*[F.lit(f) for f in fields]), enabled), lambda f: F.struct(f, F.lit(""))))


def audit_entries(raw: DataFrame) -> DataFrame:
    """Entries with an id, time, entity and action, newest first; texts trimmed, blank ones of the others null."""
    needed = {n: js.nonblank(F.col(n)) for n in ("id", "at", "entity", "action")}
    kept = raw
    for column in needed.values():
        kept = kept.filter(column.isNotNull())
    other = {n: js.nonblank(F.col(n)) for n in ("entity_id", "actor_email")}
    return kept.select(*[c.alias(n) for n, c in (needed | other).items()], "meta").orderBy(F.col("at").try_cast("timestamp").desc_nulls_last(), "id")


def forms_of(links: DataFrame, geo_id: str, project: str | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """form_id, permissions and created_at of a location's form links; of one project's forms, for which catalog(form_id, project) is needed: ValueError without it."""
    if project is not None and catalog is None:
        raise ValueError("a project's forms need the catalog that names them")
    found = links.filter(F.col("geo_id").cast("string") == geo_id)
    if project is not None:
        found = found.join(catalog.filter(F.col("project") == project).select(F.col("form_id").alias("of_form")).distinct(), F.col("form_id") == F.col("of_form"), "left_semi")
    return found.select("form_id", "permissions", "created_at")


def visible_layers(layers: DataFrame, kind: str | None = None) -> DataFrame:
    """Layers that are shown; with a kind, those of it that hold data."""
    shown = layers.filter(F.coalesce("visible", F.lit(False)))
    return shown if kind is None else shown.filter((F.col("type") == kind) & F.col("data").isNotNull())
