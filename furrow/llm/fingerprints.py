"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

A document's weighted terms are its lower-cased words with their counts. For each of SAMPLES samples every term has
its own r and c from Gamma(2, 1) and b from the unit interval, all from hashes of the term; with
t = floor(ln w / r + b) and ln a = ln c - r * (t - b + 1), the sample is the (term, t) of smallest a. Two documents
agree in a sample with probability equal to their generalised Jaccard similarity, sum of min over sum of max of the
weights. A sample is kept as one long, ln a above and a hash of (term, t) below, so that a plain minimum finds it.

Documents with their successors: ids are cut into ranges at some of the ids themselves; the first document of a range
is sent to the range before it as well, so the successor of each range's last document is at hand there.

Defined results: null and empty texts have no terms and the fingerprint NO_TERM throughout, alike only to each other; null
ids come last in descending order; rows with the same id follow the order of their texts' hashes; a single document
is its own successor; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import materialize, n_slices, whole_text

SAMPLES = 32
#: Stands for a sample of a document without terms.
NO_TERM = -1
#: Ranges of ids for each shuffle partition, and in all, for which a document is looked up in two steps of STEP.
RANGES_PER_PARTITION = 4
STEP = 32
LOWEST = -(1 << 63)


def terms(text: Column) -> Column:
    """An array of (term, weight): 64-bit hashes of the distinct lower-cased words, and their counts."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))

    def runs(h: Column) -> Column:
        places = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        counted = F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(F.get(h, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(h)) - i).alias("weight"))))
        return F.flatten(counted)

    return F.flatten(F.transform(F.array(hashes), runs))  # bound as a lambda variable, so that it is made once


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """The k-th sample's value for one term; the smallest over a document's terms is its sample."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    low21, low22, low32 = (1 << 21) - 1, (1 << 22) - 1, (1 << 32) - 1

    def unit(bits: Column, width: int) -> Column:
        return (bits + F.lit(0.5)) * F.lit(2.0**-width)

    r = -F.ln(unit(F.shiftrightunsigned(one, 43), 21) * unit(F.shiftrightunsigned(one, 22).bitwiseAND(F.lit(low21)), 21))
    b = unit(one.bitwiseAND(F.lit(low22)), 22)
    log_c = F.ln(-F.ln(unit(F.shiftrightunsigned(two, 32), 32) * unit(two.bitwiseAND(F.lit(low32)), 32)))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1)
    rank = F.floor((log_a + 128) * F.lit(float(1 << 23))).cast("long")
    return F.shiftleft(rank, 32).bitwiseOR(term.bitwiseXOR(F.shiftleft(t.cast("long"), 16)).bitwiseAND(F.lit(low32)))


def fingerprints(texts: DataFrame, keys: list[str], carried: list[str] = (), samples: int = SAMPLES) -> DataFrame:
    """keys, carried and `samples` (an array of hashes of the sampled terms) for texts(*keys, *carried, text); carried are numbers."""
    rows = texts.select(*keys, *carried, F.explode_outer(terms(F.col("text"))).alias("t")).select(*keys, *carried, "t.term", F.ln("t.weight").alias("log_weight"))
    smallest = [F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)]
    grouped = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], *smallest)
    low = [F.coalesce(F.shiftright(F.shiftleft(f"s{k}", 32), 32).cast("int"), F.lit(NO_TERM)) for k in range(samples)]
    return grouped.select(*keys, *carried, F.array(*low).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples, an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))), "")


def with_successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, key (a number of the row), next_text and next_key: the next row in descending order of ids, after the last the first."""
    text = whole_text(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[id_col].cast("long"), F.lit(LOWEST)).alias("place"), text.alias("text"))
    ranges = min(STEP * STEP, RANGES_PER_PARTITION * n_slices(docs))
    dealt = rows.select("place").repartitionByRange(ranges, F.col("place").desc())
    firsts = sorted((r["first"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.max("place").alias("first")).collect()), reverse=True)  # one for each range
    firsts = firsts or [LOWEST]
    coarse, fine = firsts[::STEP], [firsts[i : i + STEP] for i in range(0, len(firsts), STEP)]
    steps = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in coarse]), lambda x: x >= F.col("place"))) - 1
    within = F.get(F.array(*[F.array(*[F.lit(x).cast("long") for x in xs]) for xs in fine]), F.col("steps"))
    rows = rows.withColumn("steps", steps).withColumn("range", F.col("steps") * STEP + F.size(F.filter(within, lambda x: x >= F.col("place"))) - 1)
    is_first = F.col("place") == F.get(F.array(*[F.lit(x).cast("long") for x in firsts]), F.col("range"))
    here = F.struct(F.col("range").alias("at"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(len(firsts))).alias("at"), F.lit(True).alias("guest"))
    sent = rows.select("id", "place", "text", "range", F.explode(F.when(is_first, F.array(here, before)).otherwise(F.array(here))).alias("to"))
    sent = sent.select("id", "place", "text", "range", "to.at", "to.guest")
    order = Window.partitionBy("at").orderBy("guest", F.col("place").desc(), F.xxhash64("text"))
    seen = sent.select("id", "text", "range", "at", "guest", F.row_number().over(order).cast("long").alias("number"), F.lead("text").over(order).alias("next_text"), F.lead("guest").over(order).alias("guest_next"), F.lead("range").over(order).alias("next_range"))

    def key(at: Column, number: Column) -> Column:
        return F.shiftleft(at.cast("long"), 44).bitwiseOR(number)

    next_key = F.when(F.col("guest_next"), key(F.col("next_range"), F.lit(1).cast("long"))).otherwise(key(F.col("at"), F.col("number") + 1))
    return seen.filter(~F.col("guest")).select("id", "text", key(F.col("at"), F.col("number")).alias("key"), "next_text", next_key.alias("next_key"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third of code points replaced by the first as many (or all) of the following text."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


#: A SHA-256 in hexadecimal is carried as numbers of so many digits.
DIGITS = 13


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id, n_chars, edited_sha256, samples, edited_samples, near_edited and near_next of every row."""
    rows = with_successors(docs, id_col, text_col)
    rows = rows.select("id", "key", "next_key", "text", F.char_length("text").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("changed"))
    rows = rows.withColumn("sha", F.sha2("changed", 256))
    digits = [F.conv(F.substring("sha", 1 + DIGITS * i, DIGITS), 16, 10).cast("long").alias(f"sha{i}") for i in range(-(-64 // DIGITS))]
    names = [f"sha{i}" for i in range(len(digits))]
    versions = F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text")), F.struct(F.lit(1).alias("version"), F.col("changed").alias("text")))).alias("v")
    texts = rows.select("id", "key", "next_key", "n_chars", *digits, versions).select("id", "key", "next_key", "n_chars", *names, "v.version", "v.text")
    prints = materialize(fingerprints(texts, ["key", "version"], ["id", "next_key", "n_chars", *names], samples), "samples")
    sha = F.concat(*[F.lower(F.lpad(F.hex(n), min(DIGITS, 64 - DIGITS * i), "0")) for i, n in enumerate(names)])
    own = prints.filter("version = 0").select("id", "key", "next_key", "n_chars", sha.alias("edited_sha256"), "samples")
    other = prints.filter("version = 1").select("key", F.col("samples").alias("edited_samples"))
    following = prints.filter("version = 0").select(F.col("key").alias("next_key"), F.col("samples").alias("next_samples"))
    joined = own.join(other, "key").join(following, "next_key")
    return joined.select("id", "n_chars", "edited_sha256", "samples", "edited_samples", likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"), likeness(F.col("samples"), F.col("next_samples")).alias("near_next"))
