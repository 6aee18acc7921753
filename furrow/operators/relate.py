"""Relationships between layers and tables, domain decoding and cascades.

A relationship is metadata on the driver; resolving it is a join that Spark plans from the tables' sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import js

KINDS = ("one_to_one", "one_to_many", "many_to_many")


@dataclass(frozen=True)
class Relationship:
    """How a layer's key finds rows of a target; a many-to-many one goes through a junction's two keys."""

    name: str
    layer: str
    target: str
    kind: str
    source_key: str
    target_key: str
    transform: str = "none"
    fields: tuple[str, ...] = ()
    junction: str | None = None
    junction_source: str | None = None
    junction_target: str | None = None


def key_transform(key: Column, transform: str) -> Column:
    """A source key as text after trim, lower, upper or number (null unless finite); none leaves it."""
    text = key.cast("string")
    if transform == "number":
        value = js.number(text)
        return F.when(F.abs(value) < float("inf"), F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string")))
    known = {"none": text, "trim": F.trim(text), "lower": F.lower(text), "upper": F.upper(text)}
    if transform not in known:
        raise ValueError(f"unknown transform {transform!r}")
    return known[transform]


def validate(new: Relationship, existing: list[Relationship], tables: dict[str, list[str]]) -> list[str]:
    """What is wrong with a new or changed relationship; names compare without case and outer white space."""
    errors = []
    if new.kind not in KINDS:
        errors.append(f"unknown kind {new.kind}")
    columns = tables.get(new.target)
    if columns is None:
        return [*errors, f"no table {new.target}"]
    if new.target_key not in columns:
        errors.append(f"no column {new.target_key} in {new.target}")
    if len(set(new.fields)) < len(new.fields):
        errors.append("a field is selected twice")
    errors += [f"no column {f} in {new.target}" for f in new.fields if f not in columns]
    normal = lambda r: (r.layer.strip().lower(), r.target.strip().lower(), r.kind)
    if any(normal(r) == normal(new) and r.name != new.name for r in existing):
        errors.append("such a relationship exists")
    if new.kind == "many_to_many":
        if not (new.junction and new.junction_source and new.junction_target):
            errors.append("a junction with two keys is needed")
    elif new.layer.strip().lower() == new.target.strip().lower():
        errors.append("only many-to-many relates a layer to itself")
    return errors


def resolve(features: DataFrame, target: DataFrame, relation: Relationship, junction: DataFrame | None = None) -> DataFrame:
    """Every feature with each row it finds in the target (nulls where there is none), and `key_missing` for blank keys.

    Keys compare as text, whole numbers of one type as they are; the transform is for the feature's side only.
    """
    kinds = {dict(features.dtypes)[relation.source_key], dict(target.dtypes)[relation.target_key]}
    as_is = relation.transform == "none" and relation.kind != "many_to_many" and len(kinds) == 1 and kinds <= {"int", "bigint", "smallint"}
    key = F.col(relation.source_key) if as_is else F.nullif(key_transform(F.col(relation.source_key), relation.transform), F.lit(""))
    left = features.withColumn("relation_key", key)
    columns = [F.col(c).alias(f"{relation.target}_{c}") for c in (relation.fields or target.columns)]
    right = target.select((F.col(relation.target_key) if as_is else F.col(relation.target_key).cast("string")).alias("target_key"), *columns)
    if relation.kind == "many_to_many":
        hops = junction.select(F.col(relation.junction_source).cast("string").alias("hop_from"), F.col(relation.junction_target).cast("string").alias("hop_to")).distinct()
        right = hops.join(right, F.col("hop_to") == F.col("target_key")).drop("target_key", "hop_to").withColumnRenamed("hop_from", "target_key")
    joined = left.join(right, F.col("relation_key") == F.col("target_key"), "left")
    return joined.withColumn("key_missing", F.col("relation_key").isNull()).drop("relation_key", "target_key")


def decode(features: DataFrame, column: str, field_domain: DataFrame, subtype: str | None = None, subtype_domain: DataFrame | None = None) -> DataFrame:
    """Adds column_name and column_title, name (code: x), by domains (code, name); a subtype's (subtype, code, name) goes first. Of a code's several names the first by alphabet counts."""
    named = field_domain.groupBy(F.col("code").cast("string").alias("field_code")).agg(F.min("name").alias("field_name"))
    out = features.join(named, F.col(column).cast("string") == F.col("field_code"), "left")
    name = F.col("field_name")
    if subtype_domain is not None:
        own = subtype_domain.groupBy(F.col("subtype").alias("of_subtype"), F.col("code").cast("string").alias("own_code")).agg(F.min("name").alias("own_name"))
        out = out.join(own, (F.col(subtype) == F.col("of_subtype")) & (F.col(column).cast("string") == F.col("own_code")), "left")
        name = F.coalesce(F.col("own_name"), name)
    code = F.col(column).cast("string")
    shown = {f"{column}_name": F.coalesce(name, code), f"{column}_title": F.when(name.isNotNull(), F.concat(name, F.lit(" (code: "), code, F.lit(")"))).otherwise(code)}
    return out.select(*features.columns, *[c.alias(n) for n, c in shown.items()])


def encode(features: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """Puts codes in place of names where the domain has them; of a name's several codes the smallest as a text."""
    named = domain.groupBy(F.col("name").alias("of_name")).agg(F.min(F.col("code").cast("string")).alias("of_code"))
    out = features.join(named, F.col(column) == F.col("of_name"), "left")
    return out.select(*[F.coalesce("of_code", column).alias(c) if c == column else F.col(c) for c in features.columns])


def cascade(parents: DataFrame, key: str, gone: DataFrame, dependents: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What is left of the parents and of their dependents (table, foreign key) once `gone` (by key) are deleted."""
    dead = gone.select(F.col(key).alias("dead_key")).distinct()
    left = {"parents": parents.join(dead, F.col(key) == F.col("dead_key"), "left_anti")}
    return left | {name: rows.join(dead, F.col(foreign) == F.col("dead_key"), "left_anti") for name, (rows, foreign) in dependents.items()}


#: The best farm of a term: an equal code, one that begins with it, one that contains it.
SCORES = {"equal": 1000, "prefix": 900, "within": 800}


def best_option(asked: DataFrame, options: DataFrame, term: str, code: str, seq: str) -> DataFrame:
    """term, code and score: of each term's own options (term, code, seq) the best, the first of equal ones; one that doesn't fit at all scores 0 and still counts."""
    asks = asked.select(F.col(term).alias("term"), _token(F.col(term)).alias("token")).filter("token <> ''").distinct()
    own = options.select(F.col(term).alias("of_term"), F.col(code).alias("code"), _token(F.col(code)).alias("own"), F.col(seq).alias("seq")).filter("own <> ''")
    score = F.when(F.col("own") == F.col("token"), SCORES["equal"]).when(F.startswith("own", "token"), SCORES["prefix"]).when(F.contains("own", "token"), SCORES["within"]).otherwise(0)
    joined = asks.join(own, F.col("term") == F.col("of_term")).withColumn("score", score)
    best = joined.groupBy("term").agg(F.max_by(F.struct("code", "score"), F.struct("score", (-F.col("seq")).alias("first"))).alias("best"))
    return best.select("term", "best.code", "best.score")


def _token(column: Column) -> Column:
    return F.regexp_replace(F.upper(column), "[^A-Z0-9]", "")


def lookup_by_code(asked: DataFrame, farms: DataFrame, term: str, code: str, scored: bool = False) -> DataFrame:
    """term and code, and with scored the score: for each term the farm of that code; otherwise the best of those that contain it: prefixes before others, short before long, then by code.

    A term of up to three characters is itself one of the codes' runs, and its best code is found once for each run. A longer one is compared with the codes
    that hold its rarest run of three characters, so that what all codes begin with is no meeting point.
    """
    asks = asked.select(F.col(term).alias("term"), _token(F.col(term)).alias("token")).filter("token <> ''").distinct()
    codes = farms.select(F.col(code).alias("code"), _token(F.col(code)).alias("own")).filter("own <> ''").distinct()
    exact = asks.join(codes, F.col("token") == F.col("own")).groupBy("term").agg(F.min("code").alias("code")).withColumn("score", F.lit(SCORES["equal"]))
    rest = asks.join(exact, "term", "left_anti")

    def runs(text: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))

    def order(run: Column) -> Column:
        return F.struct(F.when(F.startswith("own", run), 0).otherwise(1).alias("kind"), F.char_length("own").alias("size"), F.col("code").alias("code"))

    short = []
    for size in (1, 2, 3):
        held = codes.filter(F.char_length("own") >= size).select("code", "own", F.explode(F.array_distinct(runs(F.col("own"), size))).alias("run"))
        best = held.groupBy("run").agg(F.min(order(F.col("run"))).alias("best"))
        short.append(rest.filter(F.char_length("token") == size).join(best, F.col("token") == F.col("run")).select("term", "best"))
    threes = codes.filter(F.char_length("own") >= 3).select("code", "own", F.explode(F.array_distinct(runs(F.col("own"), 3))).alias("run"))
    often = threes.groupBy("run").agg(F.count("*").alias("codes"))
    long = rest.filter(F.char_length("token") > 3)
    asked_runs = long.select("term", "token", F.explode(F.array_distinct(runs(F.col("token"), 3))).alias("run")).join(often, "run", "left")
    rarest = asked_runs.groupBy("term", "token").agg(F.min_by("run", F.struct(F.coalesce("codes", F.lit(0)).alias("codes"), F.col("run").alias("name"))).alias("run"))
    found = rarest.join(threes, "run").filter(F.contains("own", "token"))
    longer = found.groupBy("term").agg(F.min(order(F.col("token"))).alias("best"))
    every = short[0].unionByName(short[1]).unionByName(short[2]).unionByName(longer)
    found = exact.unionByName(every.select("term", "best.code", F.when(F.col("best.kind") == 0, SCORES["prefix"]).otherwise(SCORES["within"]).alias("score")))
    return found if scored else found.drop("score")


def tree(relations: DataFrame) -> DataFrame:
    """layer and relations, an array (name, target, kind) in order of names, for each layer of relations(layer, name, target, kind); metadata of a catalog, not rows of layers."""
    item = F.struct("name", "target", "kind")
    return relations.groupBy("layer").agg(F.array_sort(F.collect_list(item)).alias("relations"))


def selected(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among keys(key)."""
    return rows.join(keys.select(F.col(key).alias("of_key")), F.col(key) == F.col("of_key"), "left_semi")
