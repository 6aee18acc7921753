"""Mixing sources to target weights.

Words are summed for each source; the weights share out all words, and a source's target stops at MAX_REPEATS times its
size, what is over being shared again by weight. Closed form: with sources in the order of cap / weight, the level
is that of the first source which the remaining words, spread over the remaining weights, don't fill. A document of
a source with repetition rate r comes floor(r) times, and once more with probability r - floor(r), drawn from a hash
of its id and the seed, so reruns agree.

Sources with no words have rate 0 words to take but keep their documents once. A null text has no words; null is a source of its own
and the last in order; null ids draw like the text 'null'; rows with the same id draw alike; an empty table gives no
rows. Names of other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import WORD, carried, materialize

MAX_REPEATS = 3
SEED = 17
#: So many sources are broadcast at most (about 100 bytes each); more are joined by shuffle, with salt.
MAX_BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size and target for (source, size) rows; weights repeat along the sources by code point, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    caps = ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("cap"))
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = caps.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    ).withColumn("level", F.col("left_words") / F.col("left_weight"))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    level = F.min(F.when(fits, F.struct("cap_rank", "level"))).over(everything)["level"]
    levels = levels.withColumn("cap_rank", F.row_number().over(filling)).withColumn("final", level)
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target"))


def draw(ident: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, weights: list[int], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Every row as `row`, with id, size, source_size, target and copies."""
    rows = carried(docs, id=docs[id_col], size=word_count(docs[text_col]), source=docs[source_col])
    targets = materialize(source_targets(rows.select("source", "size"), weights), "mix-targets").withColumnRenamed("source", "of_source")
    if targets.count() <= MAX_BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("of_source")))
    else:
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("with_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(salted, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("with_salt") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    extra = (draw(F.col("id"), seed) < rate - whole).cast("long")
    return joined.select("row", "id", "size", "source_size", "target", (whole + extra).alias("copies"))


def mix(docs: DataFrame, weights: list[int], **options) -> DataFrame:
    """The mixture: every document as often as it is taken, with the columns of docs."""
    plan = mix_plan(docs, weights, **options).filter("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
