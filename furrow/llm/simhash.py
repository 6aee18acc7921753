"""SimHash near-deduplication by multi-index hashing.

A fingerprint has a bit for every bit of its shingles' hashes: one if over half of them have it. It is cut into segments; for
each, a small Hamming ball of values is enumerated and looked up in a table by segment value, and what is found is verified by the complete distance.
Equal fingerprints (or sets of shingles) count once: what is joined grows with the distinct ones, not with the copies. Two forms:

- clusters(): 64 bits, all shingles with their repeats, links at max_bits or fewer. Two fingerprints that differ in at most max_bits bits differ in at
  most max_bits // segments bits of some segment, so balls of that radius around the one side find every pair.
- near_copies(): links at a Jaccard similarity s of the sets of shingles, all of them. A set of n shingles of which fewer than s n come in other sets too is like
  none; the others meet by their shingles: two sets that similar share one of their n - ceil(s n) + 1 first ones in any order, here the rarest first, so that few
  meet by a common line. Wide fingerprints of WIDE_BITS bits say which sets of a large group to compare first. Every link is verified on the sets themselves.

The pairs of a value aren't all made. Near copies first meet the smallest node that has one of their own values, which already joins most of a large group; values that
only one component holds need no further pairs, and of values with the same holders one is enough. In ROUNDS rounds a value has a head among its holders, first the one that lies most in the middle (by how many come upon its own values), then another one for
every value, and each node is compared with up to three of its values' heads; what links is in one component and needs no comparison within it. Then members outside the
component of their head are compared with all of the value's members of other components, unless what follows their first common shingle is too little.
The result has the components of all pairs, while a large group of near copies stays linear. The links' connected
components come from alternating rounds in which every node's neighbours move to the smallest one.

Defined results: null and empty texts have fingerprint zero, which links like any other (as sets they are the empty shingle, equal to each other alone); a text
of fewer words than a shingle is one shingle; a component's id is its smallest non-null doc id (null if it has none); rows with the same id and text are one
document, so keep_one returns one; very long texts are hashed a block of words at a time, but a text and its set of shingles are held whole by one task; an
empty table gives no rows; other columns are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import bloom
from furrow.llm.common import carried, materialize, small_batches, whole_text
from furrow.llm.tokens import give_back
from furrow.session import working_tables

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = 2
#: Shingles hashed at a time, so that a very long text needs little more memory than others.
BLOCK = 1 << 14

#: The form for near copies: shingles and similarity by default, and its fingerprints.
NEAR_WORDS, SIMILARITY = 5, 0.8
WIDE_BITS, WIDE_SEGMENTS = 256, 8  # of 32 bits each
#: How far wide fingerprints of similar sets mostly differ: at most MAX_DISTANCE bits, in a segment by one of the BALL likeliest differences. No link depends on it.
WEAK, BALL, MAX_DISTANCE = 10, 48, 64
#: How often nodes are compared with heads of their places before all that are left are.
ROUNDS = 2
#: A set's shingles are counted by bucket, a bound on what two sets share; sets of more than MOST_COUNTED shingles are compared without it.
BUCKETS, MOST_COUNTED = 256, (1 << 15) - 1
#: Texts whose sets are given on at a time.
TEXTS = 500

_DRAW = np.random.default_rng(SEED)
_LANES = _DRAW.integers(0, 1 << 64, (1, WIDE_BITS // 64), dtype=np.uint64)
_ODD = _DRAW.integers(0, 1 << 64, (2, 1), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each of the text's runs of `size` words with A-Z in lower case; of all its words if they are fewer; nothing without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - size + 1, 1)
    stops = ends[size - 1 :] if len(words) >= size else ends[-1:]
    spans = zip(starts[:n].tolist(), stops.tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit of rows of 64-bit numbers, how many have it set."""
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    out = np.zeros(bits.shape[1], np.int64)
    for k in range(0, len(bits), 255):  # as many as a byte can count
        out += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return out


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """The bits set in over half of the shingles' XXH64 values."""
    found = shingle_hashes(text, size)
    counts = sum((votes(found[k : k + BLOCK]) for k in range(0, len(found), BLOCK)), np.zeros(64, np.int64))
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """rows(id, text, key) with fp in place of text, as a signed 64-bit integer; key is carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), batch.column(2)], ["id", "fp", "key"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "key").mapInArrow(run, f"id {kind}, fp long, key long")


def wide_fingerprint(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of hashes, WIDE_BITS bits as 64-bit numbers, and for each segment its WEAK bits with the closest votes, closest first."""
    counts = np.zeros(WIDE_BITS, np.int64)
    for k in range(0, len(found), BLOCK // 4):
        x = found[k : k + BLOCK // 4, None] ^ _LANES
        for odd in _ODD:
            x = x * odd
            x ^= x >> np.uint64(31)
        counts += votes(x)
    margins = np.abs(2 * counts - len(found)).reshape(WIDE_SEGMENTS, -1)
    weak = np.argsort(margins, axis=1, kind="stable")[:, :WEAK]
    return np.packbits(2 * counts > len(found), bitorder="little").view("<u8"), weak


def likely_differences() -> list[tuple[int, ...]]:
    """BALL subsets of the ranks of weak bits, likeliest first: small ones of low ranks."""
    subsets = [c for r in range(4) for c in combinations(range(WEAK), r)]
    return sorted(subsets, key=lambda c: (sum(c) + len(c), c))[:BALL]


def segment(fp: Column, k: int, segments: int = SEGMENTS) -> Column:
    low, high = 64 * k // segments, 64 * (k + 1) // segments
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) if high - low < 64 else fp


def ball(width: int, radius: int) -> list[int]:
    """The differences of up to `radius` bits in a segment."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _around(own: Column, number: int) -> Callable[[Column], Column]:
    """A place in the table of a segment's values, and whether it is the fingerprint's own."""
    return lambda difference: F.struct(F.xxhash64(F.lit(number), own.bitwiseXOR(difference)).alias("place"), (difference == 0).alias("holds"))


def asked_places(nodes: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """node, place and holds for all values that nodes(node) asks for, in every segment the ball around its own."""
    asks = []
    for k in range(segments):
        width = 64 * (k + 1) // segments - 64 * k // segments
        flips = F.array(*[F.lit(d).cast("long") for d in ball(width, max_bits // segments)])
        asks.append(F.transform(flips, _around(segment(F.col("node"), k, segments), k)))
    return nodes.select("node", F.explode(F.concat(*asks)).alias("p")).select("node", "p.place", "p.holds")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of pairs(a, b) those that have different roots."""
    for name in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}")), name, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _linked(members: DataFrame, near: Callable[[DataFrame], DataFrame], star: DataFrame | None = None, roots: DataFrame | None = None, may_link: Column | None = None, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Links with the components of all pairs (a, b) that near() keeps, among members(place, node, holds, own_value) of one place of which one at least holds it; star are links found before, roots their components.

    Beside them edges with the same components, of which the most are from a node to its root already.

    may_link leaves out pairs of a place that can't link, or share an earlier place; it says so from members' columns `more`, and the other one's with x_ before their names.
    """
    members = materialize(members, "members-of-places")
    crowds = members.groupBy("place").agg(F.count("*").alias("crowd"))
    # A node whose own values many others come upon lies in the middle of a group: the likeliest to be near the others.
    centrality = members.filter("own_value").join(crowds, "place").groupBy("node").agg(F.sum("crowd").alias("central"))
    # A node that nobody comes upon at its own values still is a head where it is the only one.
    # Each step is a table: one plan of them all, with its exchanges begun together, would take the driver's memory.
    ranked = materialize(members.filter("holds").join(centrality, "node", "left").select("place", "node", F.coalesce("central", F.lit(0)).alias("central")), "ranked-members")
    known = members.withColumns({"own": F.col("node"), "main": F.lit(None).cast("long"), "head": F.lit(None).cast("long")})
    for turn in range(ROUNDS):
        # After the middle ones, heads that differ from place to place.
        order = F.struct("central", -F.col("node")) if turn == 0 else F.struct(F.xxhash64("place", "node", F.lit(turn)), "node")
        heads = ranked.groupBy("place").agg(F.max_by("node", order).alias("new_head"))
        left = known.filter("main IS NULL OR own <> main").select("place", "node").join(heads, "place").filter("node <> new_head")
        # Each node with the heads that stand at the most of its places.
        met = left.groupBy("node", F.col("new_head").alias("head")).agg(F.count("*").alias("n"))
        best = met.groupBy("node").agg(F.max(F.struct("n", "head"))["head"].alias("first"), F.min(F.struct((-F.col("n")).alias("n"), "head"))["head"].alias("second"), F.max_by("head", F.xxhash64("head")).alias("third"))
        pairs = best.select(F.explode(F.array("first", "second", "third")).alias("head"), "node").select(*_ordered("node", "head")).distinct()
        with working_tables(members.sparkSession) as scope:
            pairs = materialize(pairs, "pairs-with-heads")
            found = scope.keep(materialize(near(pairs if roots is None else _apart(pairs, roots)), "first-links"))
        star = found if star is None else star.unionByName(found)
        # What was linked before is there as its roots.
        roots = components(found if roots is None else _as_edges(roots).unionByName(found))
        of_node = roots.select("node", F.col("root").alias("own"))
        of_head = roots.select(F.col("node").alias("head"), F.col("root").alias("main"))
        labelled = members.join(ranked.groupBy("place").agg(F.max_by("node", F.struct("central", -F.col("node"))).alias("head")), "place")
        labelled = labelled.join(of_node, "node", "left").join(of_head, "head", "left")
        known = materialize(labelled.select("place", "node", "holds", *more, "head", F.coalesce("own", "node").alias("own"), F.coalesce("main", "head").alias("main")), "rooted-members")
    apart = known.filter("own <> main").select("place", F.col("node").alias("x"), F.col("holds").alias("x_holds"), F.col("own").alias("x_own"), *[F.col(c).alias(f"x_{c}") for c in more])
    rest = known.join(apart, "place").filter((F.col("own") != F.col("x_own")) & (F.col("holds") | F.col("x_holds")) & (F.lit(True) if may_link is None else may_link))
    last = near(materialize(rest.select(*_ordered("node", "x")).distinct(), "other-pairs"))
    return star.unionByName(last), _as_edges(roots).unionByName(last)


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b"))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) of distinct fingerprints nodes(node) at most max_bits apart, with the components of all such pairs."""
    bits = bloom.array_bits(nodes.count() * segments)
    asked = asked_places(nodes, max_bits, segments)
    held = bloom.build(asked_places(nodes, 0, segments).select("place"), "place", bits)
    found = materialize(bloom.probe(asked, "place", held, bits).filter("maybe").select("node", "place", "holds", F.col("holds").alias("own_value")), "asked-places")
    # Places with one member, its own holder, have no pairs.
    some = found.groupBy("place").agg(F.count("*").alias("n"), F.max("holds").alias("held")).filter("n > 1 AND held").select("place")
    return _linked(found.join(some, "place"), lambda pairs: pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node of its component."""
    with working_tables(edges.sparkSession) as scope:
        links = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).filter("node <> root")
        current = materialize(links.distinct(), "links")
        while not _are_stars(current):
            current = _star_round(current)
        return scope.keep(current)


def _are_stars(current: DataFrame) -> bool:
    """Whether each node of current(node, root) has one root, which is no node itself: then no round changes anything."""
    ends = current.select("node", F.lit(1).alias("roots"), F.lit(0).alias("nodes")).unionByName(current.select(F.col("root").alias("node"), F.lit(0).alias("roots"), F.lit(1).alias("nodes")))
    return ends.groupBy("node").agg(F.sum("roots").alias("roots"), F.max("nodes").alias("nodes")).filter("roots > 1 OR roots = 1 AND nodes = 1").isEmpty()


def _star_round(current: DataFrame) -> DataFrame:
    """(node, root) after a round of the large and the small star."""
    with working_tables(current.sparkSession) as scope:
        # Each node's larger neighbours, and itself, go to its smallest neighbour.
        both = current.unionByName(current.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
        larger = both.filter("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = materialize(larger.unionByName(least.select("node", F.col("low").alias("root"))).filter("node <> root").distinct(), "large-star")
        # Each node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        smaller = large.join(least, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        return scope.keep(materialize(smaller.unionByName(least.select("node", F.col("low").alias("root"))).filter("node <> root").distinct(), "small-star"))


def _roots(firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component_id for firsts(node, first_id), the smallest id of each component of edges."""
    roots = components(edges).withColumnRenamed("node", "of")
    labelled = firsts.join(roots, F.col("node") == F.col("of"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return materialize(labelled.join(smallest, "root").select("node", "component_id"), "members")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(docs, text_col)
    return docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, size: int = SHINGLE_WORDS) -> DataFrame:
    """id, key (a hash of the text), fp and component_id of every row; fingerprints of `size`-word shingles link at max_bits or fewer."""
    with small_batches(docs.sparkSession):
        prints = materialize(fingerprints(_texts(docs, id_col, text_col), size), "fingerprints")
    nodes = materialize(prints.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    members = _roots(nodes, links(nodes.select("node"), max_bits))
    return prints.join(members, F.col("fp") == F.col("node")).select("id", "key", "fp", "component_id")


def sets(rows: DataFrame, size: int) -> DataFrame:
    """rows(id, text, key) with the hash `node` of the set of shingles, its size n, its wide fingerprint and its counts by bucket in place of text; key is carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for k in range(0, len(whole), TEXTS):
                batch = whole.slice(k, TEXTS)
                found = [np.unique(shingle_hashes(t.as_py(), size)) for t in batch.column(1)]
                nodes = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
                prints = [wide_fingerprint(s)[0].view(np.int64) for s in found]
                counts = [np.minimum(np.bincount((s % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), MOST_COUNTED) for s in found]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).astype(kind))) for parts, kind in ((prints, np.int64), (counts, np.int16))]
                sizes = pa.array(list(map(len, found)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes), *lists, sizes], ["id", "key", "node", "fp", "counts", "n"])
            give_back()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key long, node long, fp array<long>, counts array<short>, n int")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """node and shingles, the set itself, of rows(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for k in range(0, len(whole), TEXTS):
                found = [np.unique(shingle_hashes(t.as_py(), size)) for t in whole.column(0).slice(k, TEXTS)]
                nodes = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), lists], ["node", "shingles"])
            give_back()

    return rows.select("text").mapInArrow(run, "node long, shingles array<long>")


def nodes_with_mates(texts: DataFrame, size: int, least: float) -> DataFrame:
    """node of the sets of texts(text) that can be like another one: enough of their shingles come in other texts.

    What moves is a shingle and its count for each distinct one of a task, and a row a set. A filter that takes a shingle for a repeated one only leaves more nodes.
    """
    own = shingle_sets(texts, size)
    shared, bits = bloom.repeated(own.select(F.explode("shingles").alias("digest")), "digest")
    tested = bloom.probe(own.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("digest")), "digest", shared, bits)
    counted = tested.groupBy("node").agg(F.count_if("maybe").alias("shared"), F.first("n").alias("n"))
    return materialize(counted.filter(F.col("shared") >= F.ceil(F.col("n") * least - 1e-9)).select("node"), "nodes-with-mates")


def _first_shingles(held: DataFrame, least: float) -> DataFrame:
    """For the rarest shingles of each of held(node, shingles), as many as make any two sets that are similar enough share one: node, its n, place, its holders, and how many shingles are left from there on.

    All nodes have their places in one order, by (holders, place): two sets share no more than either has left from their first common place on.
    """
    own = held.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    counts = own.groupBy("shingle").agg(F.count("*").alias("holders"))
    ordered = own.join(counts, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("all"))  # a set, which a task has held before
    first = F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    rare = ordered.select("node", "n", F.posexplode(first).alias("number", "first")).filter("first.holders > 1")
    return rare.select("node", "n", F.col("first.shingle").alias("place"), "first.holders", (F.col("n") - F.col("number")).alias("left"))


def _own_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each of nodes(node, fp) with the smallest nodes that have the value of one of its segments: of these, the one for the most segments, and the smallest."""
    halves = F.transform("fp", lambda x: F.array(F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1))))
    own = nodes.select("node", F.posexplode(F.flatten(halves)).alias("number", "value"))
    heads = own.groupBy("number", "value").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = own.join(heads, ["number", "value"]).filter("node <> head").groupBy("node", "head").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("n", "head"))["head"].alias("first"), F.min("head").alias("second"))
    return best.select(F.explode(F.array("first", "second")).alias("head"), "node").select(*_ordered("node", "head")).distinct()


def similar_edges(nodes: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) with the components of all pairs of nodes(node, fp, counts, n) whose sets held(node, shingles) have a Jaccard similarity of `least` or more."""

    def near(pairs: DataFrame) -> DataFrame:
        one, other = (nodes.select(F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("counts", "n")]) for n in ("a", "b"))
        # Sets whose sizes differ more can't be that similar.
        sized = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - 1e-9
        # Two sets share no more of a bucket than the one with the fewer has there.
        shared = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, d: s + d)
        may_share = (F.greatest("n_a", "n_b") > MOST_COUNTED) | (shared >= (F.col("n_a") + F.col("n_b") - shared) * F.lit(least) - 1e-9)
        close = materialize(pairs.join(one, "a").join(other, "b").filter(sized & may_share).select("a", "b"), "close-pairs")
        left, right = (held.select(F.col("node").alias(n), F.col("shingles").alias(f"of_{n}")) for n in ("a", "b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        # Compared as a product, with room for the rounding of `least` alone.
        enough = both >= (F.size("of_a") + F.size("of_b") - both) * F.lit(least) - 1e-9
        return close.join(left, "a").join(right, "b").filter(enough).select("a", "b")

    with working_tables(nodes.sparkSession) as scope:
        star = scope.keep(materialize(near(materialize(_own_pairs(nodes), "own-pairs")), "own-links"))
    roots = components(star)
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    found = materialize(_first_shingles(held, least).join(rooted, "node").select("node", "root", "place", "holders", "n", "left"), "asked-places")
    # Places within one component have nothing left to find, and of those with the same members one is enough.
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"set_{k}") for k in range(2)]
    places = found.groupBy("place").agg(F.count("*").alias("n"), *same, F.min("root").alias("low"), F.max("root").alias("high"), F.first("holders").alias("holders"))
    some = places.filter("low <> high").groupBy("n", "set_0", "set_1").agg(F.min_by("place", F.struct("holders", "place")).alias("place")).select("place")
    members = found.join(some, "place").select("place", "node", F.lit(True).alias("holds"), F.lit(True).alias("own_value"), "n", "left")
    # What two sets must share, and may from this place on; it is so at the first place they share, if they are similar.
    may_link = F.least("left", "x_left") * F.lit(1 + least) >= (F.col("n") + F.col("x_n")) * F.lit(least) - 1e-6
    return _linked(members, near, star, roots, may_link, ("n", "left"))[1]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = NEAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """id, key (a hash of the text), fp (a hash of the set of shingles) and component_id of every row; sets of `size`-word shingles link at a Jaccard similarity of `least`."""
    texts = _texts(docs, id_col, text_col)
    with small_batches(docs.sparkSession):
        found = materialize(sets(texts, size), "fingerprints-of-sets")
        mates = nodes_with_mates(texts, size, least)
    firsts = materialize(found.groupBy("node").agg(F.min("id").alias("first_id"), F.min("key").alias("key")), "distinct-sets")

    def passing(rows: DataFrame, digests: DataFrame) -> DataFrame:
        bits = bloom.array_bits(digests.count())
        return bloom.probe(rows, "digest", bloom.build(digests, "digest", bits), bits).filter("maybe").drop("maybe")

    # Rows that pass the filter, copies of a set being one by then, are few beside the others; those that passed by chance go last.
    some = passing(found.withColumn("digest", F.xxhash64("node")), mates.select(F.xxhash64("node").alias("digest")))
    once = some.groupBy("node").agg(*[F.first(n).alias(n) for n in ("fp", "counts", "n")])
    nodes = materialize(once.join(mates, "node", "left_semi"), "nodes")
    # A set is made again from one of its texts: all sets would take twice the room of the texts.
    keys = materialize(mates.join(firsts, "node").select(F.col("key").alias("digest")), "wanted-texts")
    # Tasks drop their own copies first, so a text moves once from a task at most.
    wanted = passing(texts.select("text", F.col("key").alias("digest")), keys).dropDuplicates(["digest"]).join(keys, "digest", "left_semi")
    with small_batches(docs.sparkSession):
        held = materialize(shingle_sets(wanted, size), "wanted-shingles")

    members = _roots(firsts.select("node", "first_id"), similar_edges(nodes, held, least))
    return found.select("id", "key", "node").join(members, "node").select("id", "key", F.col("node").alias("fp"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = NEAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """The document with the smallest id of each group of near copies, with the columns of docs. Of the working tables only those that say which rows go are left."""
    with working_tables(docs.sparkSession) as scope:
        gone, multiple = (scope.keep(t) for t in _goes(near_copies(docs, id_col, text_col, size, least)))
    return _without(docs, gone, multiple, id_col, text_col)


def keep_first(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component of members, which is the outcome of clusters() or near_copies()."""
    return _without(docs, *_goes(members), id_col, text_col)


def _goes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which rows go, by (id, key), and the key that stays of each id that heads a component more than once."""
    found = materialize(members, "clusters")
    heads = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("key").alias("head_key"), F.count("*").alias("n"))
    same = F.col("id").eqNullSafe(F.col("component_id"))
    multiple = materialize(heads.filter("n > 1 AND component_id IS NOT NULL").select(F.col("component_id").alias("head_id"), "head_key"), "repeated-ids")
    gone = found.filter(~same).select("id", "key")
    # Some ids come more than once: of different texts of one id the one with the smallest hash stays.
    other = found.filter(same).join(multiple, (F.col("id") == F.col("head_id")) & (F.col("key") != F.col("head_key")))
    return materialize(gone.unionByName(other.select("id", "key")).distinct(), "near-copies"), multiple


def _without(docs: DataFrame, gone: DataFrame, multiple: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = carried(docs, id=docs[id_col], key=F.xxhash64(whole_text(docs, text_col)))
    kept = bloom.without(rows, ["id", "key"], gone)
    if not multiple.isEmpty():
        kept = kept.join(multiple, F.col("id") == F.col("head_id"), "left")
        kept = kept.filter("head_id IS NULL").select("row").unionByName(kept.filter("head_id IS NOT NULL").dropDuplicates(["id", "key"]).select("row"))
    return kept.select("row.*")
