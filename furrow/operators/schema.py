"""Columns and layers of a catalog: what is shown, in which order, under which name, and what may be changed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import js
from furrow.operators.layers import default_value

FIELD_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
KINDS = ("text", "number", "date", "boolean")
PREFIXES = ("arcgis:", "geojson:", "url:")

# What each role may do besides an Admin, who may do all.
PERMISSIONS = {"dataSource.update": ("Manager",), "admin.users.manage": ("Manager", "Admin Manager")}


# What is said about a name or length that can't be.
NAME_REQUIRED = "Field name is required."
NAME_MALFORMED = "Field name must start with a letter/underscore and contain only letters, numbers, and underscores."
NAME_TAKEN = "Field name already exists."
LENGTH_MALFORMED = "Length must be a positive number."


def visible(rows: DataFrame, hidden: list[str]) -> DataFrame:
    """Without the hidden columns; names that aren't there are ignored."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in hidden])


def field_problem(name: str, existing: list[str], kind: str = "text", length: str = "", renamed: str | None = None) -> str | None:
    """Why a column can't have this name, kind and length, or None."""
    name = " ".join(name.split())
    if not name:
        return NAME_REQUIRED
    if not FIELD_NAME.match(name):
        return NAME_MALFORMED
    if name.lower() in [e.lower() for e in existing if e != renamed]:
        return NAME_TAKEN
    if kind == "text" and length.strip():
        try:
            good = 0 < float(length) < float("inf")
        except ValueError:
            good = False
        return None if good else LENGTH_MALFORMED
    return None


def add_field(rows: DataFrame, name: str, kind: str = "text", default: str = "") -> DataFrame:
    if problem := field_problem(name, rows.columns, kind):
        raise ValueError(problem)
    return rows.withColumn(name, default_value(default, kind))


def rename_field(rows: DataFrame, old: str, new: str) -> DataFrame:
    if problem := field_problem(new, rows.columns, renamed=old):
        raise ValueError(problem)
    return rows.withColumnRenamed(old, new)


def drop_field(rows: DataFrame, name: str, relation_keys: list[str]) -> DataFrame:
    """Without a column, unless a relationship needs it."""
    if name in relation_keys:
        raise ValueError(f"{name} is a relationship's key")
    return rows.drop(name)


def move_field(rows: DataFrame, name: str, to: int) -> DataFrame:
    """A column at another place; places past an end are the end."""
    rest = [c for c in rows.columns if c != name]
    to = max(0, min(len(rest), to))
    return rows.select(*rest[:to], name, *rest[to:])


def group_key(ident: Column) -> Column:
    """The prefix before the first colon in lower case (so http and https too), or custom."""
    trimmed = F.trim(ident)
    return F.when(F.instr(trimmed, ":") > 1, F.lower(F.substring_index(trimmed, ":", 1))).otherwise("custom")


def name_candidates(ident: Column) -> Column:
    """The ids under which a layer's name may be found: its own, without its prefix, or for a web address with each prefix."""
    lower = F.lower(ident)
    stripped = [F.when(F.startswith(lower, F.lit(p)), F.substring(ident, len(p) + 1, 1 << 20)) for p in PREFIXES]
    added = [F.when(lower.rlike("^https?://"), F.concat(F.lit(p), ident)) for p in ("arcgis:", "url:", "geojson:")]
    return F.array_compact(F.array(ident, *stripped, *added))


def display_names(sources: DataFrame, ident: str, names: DataFrame) -> DataFrame:
    """Adds display_name: the name of the first candidate id that names(id, name) has, or the id itself."""
    tried = sources.select(F.col(ident).alias("source_id"), F.posexplode(name_candidates(F.col(ident))).alias("place", "candidate")).distinct()
    known = names.select(F.col("id").alias("known_id"), js.nonblank(F.col("name")).alias("known_name")).filter("known_name IS NOT NULL")
    found = tried.join(known, F.col("candidate") == F.col("known_id")).groupBy("source_id").agg(F.min_by("known_name", "place").alias("found_name"))
    joined = sources.join(found, F.col(ident) == F.col("source_id"), "left")
    return joined.select(*sources.columns, F.coalesce("found_name", ident).alias("display_name"))


def layer_summary(layers: DataFrame) -> DataFrame:
    """id, name, geometry type of the first feature that has one, and number of features, of layers with an array `features`."""
    first = F.get(F.filter(F.transform("features", lambda f: f["geometry_type"]), lambda t: t.isNotNull()), 0)
    return layers.select("id", "name", F.coalesce(first, F.lit("Unknown")).alias("geometry_type"), F.coalesce(F.size("features"), F.lit(0)).alias("records"))


def normal_role(role: Column) -> Column:
    """A known role; Viewer for any other."""
    raw = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    both = F.contains(raw, F.lit("admin")) & F.contains(raw, F.lit("manager"))
    return F.when(raw == "admin", "Admin").when(raw == "manager", "Manager").when(both, "Admin Manager").when(raw == "editor", "Editor").otherwise("Viewer")


def allowed(permission: str, role: Column) -> Column:
    return normal_role(role).isin("Admin", *PERMISSIONS.get(permission, ()))


def normal_users(raw: DataFrame) -> DataFrame:
    """Users with an e-mail address, trimmed, defaults filled in."""
    email = js.nonblank(F.col("email"))
    return raw.filter(email.isNotNull()).select(
        email.alias("email"), F.coalesce(F.nullif("name", F.lit("")), email).alias("name"), normal_role(F.col("role")).alias("role"),
        js.nonblank(F.col("scope")).alias("scope"), F.coalesce(F.nullif("status", F.lit("")), F.lit("Active")).alias("status"),
    )
