"""Bloom filters as small tables of bitmaps, built and tested by DataFrame operations alone.

A filter has two bit arrays; a hash sets one cell in each. It is a table of (bucket, words) with 4 KB a row, and
never has more than MAX_FILTER_BITS bits, so it can be broadcast whatever the input's size. Tasks set the bits of their own rows first, so that
bitmaps move and not rows. Past the size at which that gives BITS_PER_ROW bits a row more rows pass the test by chance.
Every test here is followed by an exact one, so that costs time only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import materialize

BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 28
#: A bitmap has 4096 bytes.
BITMAP_BITS = 32768


def array_bits(rows: int, most: int = MAX_FILTER_BITS) -> int:
    """Bits of each of the two arrays: a power of two that gives both together BITS_PER_ROW bits a row, up to `most`."""
    return max(BITMAP_BITS, min(most // 2, 1 << max(1, rows * BITS_PER_ROW // 2 - 1).bit_length()))


def cells(digest: Column, bits: int) -> list[Column]:
    """A cell in each array, from the low and the high half of a 64-bit hash."""
    low = digest.bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned(digest, 32).bitwiseAND(F.lit(bits - 1))
    return [low, high + F.lit(bits)]


def build(hashes: DataFrame, digest: str, bits: int) -> DataFrame:
    """The filter of all the hashes."""
    touched = hashes.select(F.explode(F.array(*cells(F.col(digest), bits))).alias("cell"))
    position = F.col("cell").bitwiseAND(F.lit(BITMAP_BITS - 1))
    bitmaps = touched.groupBy(F.shiftright("cell", 15).alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bitmap"))
    return materialize(bitmaps.select("bucket", _words(F.col("bitmap")).alias("words")), "bloom")


def repeated(hashes: DataFrame, digest: str, most: int = MAX_FILTER_BITS) -> tuple[DataFrame, int]:
    """The filter of the hashes that come more than once, and the bits of each of its arrays.

    What moves for it is a hash and a count for each distinct hash of a task; rows and texts don't.
    """
    counted = hashes.groupBy(F.col(digest).alias("digest")).agg(F.count("*").alias("n"))
    again = materialize(counted.filter("n > 1").select("digest"), "repeated-hashes")
    bits = array_bits(again.count(), most)
    return build(again, "digest", bits), bits


def _words(bitmap: Column) -> Column:
    """The bytes of a bitmap, four to an integer."""

    def word(i: Column) -> Column:
        unsigned = F.conv(F.hex(F.substring(bitmap, i * 4 + 1, F.lit(4))), 16, 10).cast("long")
        return (unsigned.bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(BITMAP_BITS // 32 - 1)), word)


def probe(rows: DataFrame, digest: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """rows with `maybe`: whether both cells of the hash are in the filter."""
    out, tests = rows, []
    for k, cell in enumerate(cells(F.col(digest), bits)):
        side = bitmaps.select(F.col("bucket").alias(f"bucket_{k}"), F.col("words").alias(f"words_{k}"))
        out = out.join(F.broadcast(side), F.shiftright(cell, 15) == F.col(f"bucket_{k}"), "left")  # MAX_FILTER_BITS / 8 bytes at most
        at = cell.bitwiseAND(F.lit(BITMAP_BITS - 1)).cast("int")
        # The first of a word's four bytes is its highest.
        bit = at.bitwiseXOR(F.lit(24)).bitwiseAND(F.lit(31))
        tests.append(F.coalesce(F.getbit(F.get(F.col(f"words_{k}"), F.shiftright(at, 5)), bit) == 1, F.lit(False)))
    return out.withColumn("maybe", reduce(lambda a, b: a & b, tests)).select(*rows.columns, "maybe")


def without(rows: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """The rows whose keys aren't in gone(*keys), nulls being equal.

    A filter of the keys that are gone lets all other rows pass but a few. Which of those are meant is found from keys alone;
    only they, by a filter of their own, are shuffled whole.
    """
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])

    def renamed(table: DataFrame) -> DataFrame:
        return table.select(*[F.col(k).alias(f"of_{k}") for k in keys])

    def tested(table: DataFrame, by: DataFrame) -> DataFrame:
        bits = array_bits(by.count())
        return probe(table, "digest", build(by.select(F.xxhash64(*keys).alias("digest")), "digest", bits), bits)

    marked = tested(rows.withColumn("digest", F.xxhash64(*keys)), gone)
    doubtful = marked.filter("maybe").drop("maybe")
    spared = materialize(doubtful.select(*keys).distinct().join(renamed(gone), match, "left_anti"), "spared")
    back = tested(doubtful, spared).filter("maybe").join(renamed(spared), match, "left_semi")
    return marked.filter(~F.col("maybe")).select(*rows.columns).unionByName(back.select(*rows.columns))
