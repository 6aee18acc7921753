"""Filters, orders and counts of the lists that the clients show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.schema import group_key

# Answers that count as satisfied.
SATISFIED = ("very_satisfied", "satisfied")
ALL = "All"


def filter_layers(layers: DataFrame, search: str = "", group: str = "all", selected: DataFrame | None = None) -> DataFrame:
    """Layers of a group, of the selected ids(id), whose name or id contains the search text in any case."""
    kept = layers if group == "all" else layers.filter(group_key(F.col("id")) == group)
    kept = kept if selected is None else kept.join(selected.select("id"), "id", "left_semi")
    asked = search.strip().lower()
    return kept.filter(F.contains(F.lower("name"), F.lit(asked)) | F.contains(F.lower("id"), F.lit(asked))) if asked else kept


def search_layers(layers: DataFrame, search: str) -> DataFrame:
    """Layers whose name or geometry type contains the text in any case, or whose id contains it in lower case."""
    asked = F.lit(search.strip().lower())
    return layers.filter(F.contains(F.lower("name"), asked) | F.contains(F.lower("geometry_type"), asked) | F.contains("id", asked))


def filter_users(users: DataFrame, search: str = "", role: str = ALL, status: str = ALL) -> DataFrame:
    asked = F.lit(search.lower())
    kept = users.filter(F.contains(F.lower("name"), asked) | F.contains(F.lower("email"), asked)) if search else users
    kept = kept if role == ALL else kept.filter(F.col("role") == role)
    return kept if status == ALL else kept.filter(F.col("status") == status)


def sorted_by(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By one column, null as an empty text."""
    key = F.coalesce(F.col(column).cast("string"), F.lit("")) if dict(rows.dtypes)[column] == "string" else F.col(column)
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first())


def audit_visible(log: DataFrame, actor_email: str, actor_role: str) -> DataFrame:
    """Entries about users: all for an admin or a manager, its own for an admin manager, none for others."""
    about = log.filter("entity = 'user'")
    if actor_role in ("Admin", "Manager"):
        return about
    return about.filter(F.lower("actor_email") == actor_email.lower()) if actor_role == "Admin Manager" else about.filter(F.lit(False))


def issues_only(items: DataFrame) -> DataFrame:
    return items.filter("pull_request IS NULL")


def toggled(selected: DataFrame, shown: DataFrame, on: bool) -> DataFrame:
    """The selection (id) with all shown ids, or without them."""
    return selected.select("id").union(shown.select("id")).distinct() if on else selected.select("id").subtract(shown.select("id"))


def counted(rows: DataFrame, test: Column, name: str = "count") -> DataFrame:
    return rows.agg(F.count_if(test).alias(name))


def satisfaction(responses: DataFrame) -> DataFrame:
    """Satisfied answers in whole percent; 0 without answers."""
    share = 100 * F.count_if(F.col("satisfaction").isin(*SATISFIED)) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return responses.agg(F.coalesce(F.floor(share + 0.5), F.lit(0)).cast("long").alias("percent"))


def completion(tasks: Column) -> Column:
    """Done tasks of a map of booleans in whole percent; 0 without tasks."""
    done = F.size(F.filter(F.map_values(tasks), lambda d: d))
    return F.when(F.size(tasks) > 0, F.floor(100 * done / F.size(tasks) + 0.5)).otherwise(0).cast("long")


def grouped_layers(layers: DataFrame) -> DataFrame:
    """(group, ids) for each prefix, ids in order; a catalog's layers, not their features."""
    return layers.groupBy(group_key(F.col("id")).alias("group")).agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("group")
