"""Catalog tables: inserts, updates and deletes as new tables, caps, paging, search and who may see what.

A table is never changed in place: each operation gives the rows that the next version has.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import js

# Roles by rank, and what the lowest two are.
ROLE_RANK = ["Viewer", "Editor", "Admin Manager", "Admin", "Manager"]
MANAGED_ROLES = ("Editor", "Viewer")
MAX_PAGE, RECORD_PAGES = 100, (25, 50, 100, 200)
#: Letters with an accent, and the plain ones: of all that decompose into a letter of ASCII and marks.
_ACCENTED = {chr(c): d[0] for c in range(0xC0, 0x1F00) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii() and d[0].isalpha()}


def insert(base: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the next version, the rejected rows with `reason`): a key is required, and neither taken nor given twice."""
    missing = js.nonblank(F.col(key)).isNull()
    once = Window.partitionBy(key).orderBy("seq")
    numbered = new.filter(~missing).withColumn("nth", F.row_number().over(once))
    taken = base.select(F.col(key).alias("taken_key")).distinct()
    good = numbered.filter("nth = 1").join(taken, F.col(key) == F.col("taken_key"), "left_anti")
    double = numbered.join(taken, F.col(key) == F.col("taken_key"), "left").filter((F.col("nth") > 1) | F.col("taken_key").isNotNull())
    rejected = new.filter(missing).select(*new.columns, F.lit("key required").alias("reason")).unionByName(double.select(*new.columns, F.lit("key exists").alias("reason")))
    return base.unionByName(good.select(*base.columns)), rejected


def merge(base: DataFrame, patch: DataFrame, key: str, columns: list[str], seq: str | None = None) -> DataFrame:
    """Updates by key: the columns named in a patch row's `patched` array get its values, nulls too; keys stay.

    Of several patches of a key the last by seq that names a column counts for it; without seq, one of them.
    """
    last = [F.max_by(F.struct(F.col(c).alias("value")), F.when(F.array_contains("patched", c), F.col(seq) if seq else F.lit(0)))["value"].alias(f"patch_{c}") for c in columns]
    named_by = [F.max(F.array_contains("patched", c)).alias(f"names_{c}") for c in columns]
    changes = patch.groupBy(F.col(key).alias("patch_key")).agg(*last, *named_by)
    joined = base.join(changes, F.col(key) == F.col("patch_key"), "left")
    named = lambda c: F.coalesce(F.col(f"names_{c}"), F.lit(False))
    return joined.select(*[F.when(named(c), F.col(f"patch_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def delete(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(F.col(key).cast("string").alias("gone_key")), F.col(key).cast("string") == F.col("gone_key"), "left_anti")


def replace_group(base: DataFrame, new: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """The groups that new has rows of are replaced whole, and so are those in groups(group): one without new rows is then empty."""
    gone = new.select(F.col(group).alias("new_group"))
    gone = gone if groups is None else gone.union(groups.select(group))
    return base.join(gone.distinct(), F.col(group) == F.col("new_group"), "left_anti").unionByName(new)


def newest(log: DataFrame, cap: int, order: list[str], by: list[str] = ()) -> DataFrame:
    """The `cap` newest rows, of each group where `by` names one."""
    latest = [F.col(c).desc() for c in order]
    if not by:
        return log.orderBy(*latest).limit(cap)
    return log.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*latest))).filter(F.col("nth") <= cap).drop("nth")


def keep_first(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), seq).alias("row")).select("row.*")


def keep_last(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key, with the place of its first as `first_seq`."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), seq).alias("row"), F.min(seq).alias("first_seq")).select("row.*", "first_seq")


def duplicated_keys(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def page(rows: DataFrame, order: list[Column], limit: int | None = 20, offset: int | None = 0) -> tuple[DataFrame, int]:
    """(a page, the number of all rows); the limit is brought into 1 to 100, the offset to 0 or more."""
    limit, offset = max(1, min(MAX_PAGE, 20 if limit is None else limit)), max(0, offset or 0)
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def record_page(rows: DataFrame, order: list[Column], size: int = 25, number: int = 0) -> tuple[DataFrame, int]:
    """(page `number` from 0, the number of pages); sizes are RECORD_PAGES, and a number past the last page is the last."""
    if size not in RECORD_PAGES:
        raise ValueError(f"pages have {RECORD_PAGES} rows")
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset(size * max(0, min(number, pages - 1))).limit(size), pages


def latest_texts(rows: DataFrame, *columns: str) -> DataFrame:
    """Newest first by texts put together, such as a date and a time; null is an empty text."""
    return rows.orderBy(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).desc())


def equals_text(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose value, as a client would write it, is this text; null is an empty text."""
    if column not in rows.columns:
        raise ValueError(f"no column {column}")
    shown = F.col(column).cast("string")
    if dict(rows.dtypes)[column] in ("double", "float"):
        shown = F.regexp_replace(shown, r"\.0$", "")
    return rows.filter(F.coalesce(shown, F.lit("")) == value)


def search(rows: DataFrame, query: str, columns: list[str], most_columns: int = 20) -> DataFrame:
    """Rows whose first columns, joined and in lower case, contain the query."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns[:most_columns]]))
    return rows.filter(F.contains(text, F.lit(query.lower())))


def natural_key(text: Column) -> Column:
    """Orders runs of digits by their number, whatever its length, and other runs without case and accents.

    A number is written as the count of its digits, then its digits.
    """
    plain = F.regexp_replace(F.translate(text, "".join(_ACCENTED), "".join(_ACCENTED.values())), r"\p{M}+", "")
    runs = F.regexp_extract_all(F.lower(plain), F.lit(r"(\d+|\D+)"), F.lit(1))

    def counted(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        return F.concat(F.lpad(F.char_length(digits).cast("string"), 9, "0"), digits)

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), counted(r)).otherwise(r)), "")


def suggest(rows: DataFrame, column: str, term: str, most: int = 20) -> DataFrame:
    """The best matches of a term: equal 1000, prefix 900, within 800; ties in natural order."""
    token = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    own, asked = token(F.col(column)), token(F.lit(term))
    score = F.when(own == asked, 1000).when(F.startswith(own, asked), 900).when(F.contains(own, asked), 800)
    return rows.withColumn("score", score).filter("score IS NOT NULL").orderBy(F.col("score").desc(), natural_key(F.col(column)), column).limit(most)


def role_rank(role: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in ROLE_RANK]), role)


def best_role(accounts: DataFrame, by: list[str], role: str, seq: str) -> DataFrame:
    """The highest role of each group; the first of equal ones."""
    return accounts.groupBy(*by).agg(F.max_by(role, F.struct(role_rank(F.col(role)).alias("rank"), (-F.col(seq)).alias("first"))).alias("role"))


def visible_users(users: DataFrame, actor_id: int, actor_role: str, actor_scope: str | None) -> DataFrame:
    """Admins and managers see all; an admin manager itself, and editors and viewers of its scope that it manages; others nobody."""
    if actor_role in ("Admin", "Manager"):
        return users
    if actor_role != "Admin Manager":
        return users.filter(F.lit(False))
    own = (F.col("scope") == actor_scope) & (F.col("managed_by") == actor_id) & F.col("role").isin(*MANAGED_ROLES)
    return users.filter((F.col("user_id") == actor_id) | own)


def first_nonblank(rows: DataFrame, by: list[str], column: str, seq: str) -> DataFrame:
    blank = F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""
    return rows.filter(~blank).groupBy(*by).agg(F.min_by(column, seq).alias(column))


def order_missing_last(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows by their place in order(key, place); those without a place come last, by key."""
    places = order.select(F.col(key).alias("of_key"), "place")
    return rows.join(places, F.col(key) == F.col("of_key"), "left").orderBy(F.col("place").asc_nulls_last(), key).drop("of_key", "place")


def sorted_layers(layers: DataFrame, mode: str, order: DataFrame | None = None, descending: bool = False) -> DataFrame:
    """Layers (id, name, created_at) by priority (their place in order(id, place), others last), name or date; descending turns the whole list round."""
    keys = {"name": [natural_key(F.col("name")), F.col("id")], "date": [F.coalesce("created_at", F.lit("")), F.col("id")]}
    if mode == "priority":
        places = order.select(F.col("id").alias("of_id"), "place")
        found = layers.join(places, F.col("id") == F.col("of_id"), "left")
        ranks = [F.coalesce(F.col("place").cast("long"), F.lit((1 << 53) - 1)), F.col("id")]
        return found.orderBy(*[c.desc() if descending else c.asc() for c in ranks]).drop("of_id", "place")
    if mode not in keys:
        raise ValueError(f"unknown mode {mode!r}")
    return layers.orderBy(*[c.desc() if descending else c.asc() for c in keys[mode]])


def fallback_rows(found: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """What was found, and of the fallback what it lacks."""
    have = found.select(F.col(key).alias("have_key"))
    return found.unionByName(fallback.join(have, F.col(key) == F.col("have_key"), "left_anti"), allowMissingColumns=True)


def fan_out(updates: DataFrame, targets: DataFrame) -> DataFrame:
    """Every update for every target: targets(target, enabled) is the few sources of one form, and a target takes its enabled keys only."""
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return updates.join(F.broadcast(targets)).withColumn("props", F.map_filter("props", lambda k, _: F.array_contains(F.col("enabled"), k)))


#: A form's sources.
MAX_TARGETS = 100

