"""Each operator beside brute force, and on rows with every oddity."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA  # noqa: F401
from pyspark.sql import functions as F

from furrow.llm import bloom, exact_dedup, fingerprints, mixing, packing, pii, quality, sharding, simhash, token_counts, token_store
from furrow.llm.tokens import Encoder

BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SMALL = "/root/testdata/sf0.001"


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def library(path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def encoded(encoder, texts):
    """The ids of each text, without the end id."""
    return [own[:-1].tobytes() for _, ids, counts in encoder.blocks(pa.array(texts), 7) for own in np.split(ids, np.cumsum(counts)[:-1])]


# Exact dedup


def test_exact_dedup_brute_force(documents):
    groups = defaultdict(list)
    for doc, text in texts_of(documents).items():
        groups[text].append(doc)
    expected = {d: (max(ds), len(ds), d == max(ds), hashlib.sha256(t.encode()).hexdigest()) for t, ds in groups.items() for d in ds}
    found = exact_dedup.mark_duplicates(documents).collect()
    assert {r.id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == expected
    assert len(found) == len(expected)
    assert exact_dedup.keep_unique(documents).count() == len(groups)


def test_exact_dedup_oddities(tricky, nothing):
    found = exact_dedup.mark_duplicates(tricky).collect()
    assert len(found) == tricky.count()
    assert sorted((r.group_size, r.keep_id) for r in found if r.row.text == "the same text of some words") == [(4, 5)] * 4
    assert {r.group_size for r in found if not r.row.text} == {3}
    kept = exact_dedup.keep_unique(tricky)
    assert kept.columns == tricky.columns
    assert Counter(r.text or "" for r in kept.collect()).most_common(1)[0][1] == 1
    assert exact_dedup.mark_duplicates(nothing).count() == 0


def test_exact_dedup_is_right_with_a_full_filter(documents):
    small = exact_dedup.mark_duplicates(documents, max_filter_bits=2)
    whole = exact_dedup.mark_duplicates(documents)
    columns = ["id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(small.select(columns).collect()) == sorted(whole.select(columns).collect())


def test_bloom_filter_has_no_false_negatives(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("digest"), "id")
    bits = bloom.array_bits(10_000)
    found = bloom.probe(rows, "digest", bloom.build(rows.filter("id < 10000").select("digest"), "digest", bits), bits)
    counts = {r.inside: r.n for r in found.filter("maybe").groupBy((F.col("id") < 10000).alias("inside")).agg(F.count("*").alias("n")).collect()}
    assert counts[True] == 10_000 and counts.get(False, 0) < 500


# Sharding


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding_brute_force(documents, shards):
    texts = texts_of(documents)
    size = {d: len(t.encode()) + 16 for d, t in texts.items()}
    total, start, expected, slots = sum(size.values()), 0, {}, Counter()
    for d in sorted(size):
        shard = (2 * start + size[d]) * shards // (2 * total)
        expected[d] = (size[d], zlib.crc32(texts[d].encode()), shard, slots[shard])
        slots[shard] += 1
        start += size[d]
    found = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard_plan(documents, shards).collect()}
    assert found == expected


def test_sharding_oddities(tricky, nothing, documents, tmp_path):
    rows = sharding.shard_plan(tricky, 5).collect()
    assert len(rows) == tricky.count()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard_plan(nothing, 3).count() == 0
    sharding.write_shards(documents, 3, f"{tmp_path}/out")
    assert documents.sparkSession.read.parquet(f"{tmp_path}/out").drop("shard", "slot").exceptAll(documents).count() == 0


# Tokens


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encoder_is_the_library(path, documents):
    rng = np.random.default_rng(3)
    odd = ["", "  ", "\n\n a", "it's  <|endoftext|>ok", "  a 　\tb  c", "İ K É", "x" * 300]
    odd += ["".join(rng.choice(list(" \n\tab'sE1. 　日́,"), 40)) for _ in range(1500)]
    all_texts = odd + list(texts_of(documents).values())
    expected = [np.array(e.ids, "<u4").tobytes() for e in library(path).encode_batch(all_texts, add_special_tokens=False)]
    assert encoded(Encoder(path), all_texts) == expected


def test_encoder_forgets_and_stays_right(documents, monkeypatch):
    from furrow.llm import tokens

    monkeypatch.setattr(tokens, "MAX_WORDS", 50)
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 1000)
    texts = list(texts_of(documents).values())
    assert encoded(Encoder(BYTE_BPE), texts) == [np.array(e.ids, "<u4").tobytes() for e in library(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]


def test_token_store_round_trip(spark, documents, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(documents, path, BYTE_BPE, end_id=2)
    texts = texts_of(documents)
    ids = {d: np.array([*e.ids, 2], "<u4") for d, e in zip(texts, library(BYTE_BPE).encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    found = {r.doc_id: r for r in token_store.read_digests(spark, path).collect()}
    start = 0
    for d in sorted(ids):
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32, found[d].verified) == (start, len(ids[d]), zlib.crc32(ids[d].tobytes()), True)
        start += len(ids[d])
    back = {r.doc_id: np.frombuffer(r.ids, "<u2").astype("<u4").tobytes() for r in token_store.read_ids(spark, path).collect()}
    assert back == {d: i.tobytes() for d, i in ids.items()}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk").distinct().count() and chunks.agg(F.sum("n")).first()[0] < start
    assert [r.doc_id for r in spark.read.parquet(f"{path}/recipes").orderBy("place").collect()] == sorted(ids)
    assert token_store.manifest_holds(spark, path)


def test_token_store_finds_damage(spark, documents, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(documents.limit(20), path, BYTE_BPE, end_id=2)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    damaged = [(r.chunk, r.n, b"\x01\x01" + r.ids[2:]) if i == 0 else tuple(r) for i, r in enumerate(chunks)]
    spark.createDataFrame(damaged, "chunk binary, n int, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    assert token_store.read_digests(spark, path).filter("NOT verified").count() >= 1


def test_token_store_misses_a_lost_recipe(spark, documents, tmp_path):
    path = f"{tmp_path}/store"
    token_store.write_store(documents, f"file://{path}", BYTE_BPE, 2)
    assert token_store.read_digests(spark, f"file://{path}").filter("verified").count() == documents.count()
    lost = next(p for p in (tmp_path / "store" / "recipes").rglob("*.parquet") if not p.name.startswith("."))
    lost.unlink()
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_digests(spark, f"file://{path}")


def test_token_store_oddities(spark, tricky, nothing, tmp_path):
    token_store.write_store(tricky, f"file://{tmp_path}/a", BYTE_BPE, end_id=2)
    rows = token_store.read_digests(spark, f"file://{tmp_path}/a").collect()
    assert len(rows) == tricky.count() and all(r.verified for r in rows)
    token_store.write_store(nothing, f"file://{tmp_path}/b", BYTE_BPE, end_id=2)
    assert token_store.read_digests(spark, f"file://{tmp_path}/b").count() == 0


def test_chunks_move_with_their_content():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 50_000, 5000, dtype=np.uint32)
    cut = lambda ids: {ids[a:b].tobytes() for a, b in zip([0, *e[:-1]], e, strict=True)} if (e := next(token_store.chunk_ends(ids, np.array([len(ids)])))) else set()
    one, two = cut(shared), cut(np.concatenate([rng.integers(0, 50_000, 333, dtype=np.uint32), shared]))
    assert len(one & two) >= len(one) - 3


def test_joined_crcs():
    data = bytes(range(256)) * 5
    cuts = [[0, 1, 7, 7, 500, len(data)], [], [3, 4]]
    parts = [(data[a:b]) for c in cuts for a, b in zip(c, c[1:], strict=False)]
    found = token_store.joined_crcs(np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), np.array([5, 0, 1]))
    assert found.tolist() == [zlib.crc32(data), 0, zlib.crc32(data[3:4])]


def test_token_counts_are_the_unigram_model(documents, tricky, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_counts.vocabulary(PIECES)
    model = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.SPACE, prepend_scheme="always", split=True)
    for table in (documents, tricky):
        for r in token_counts.token_counts(table.filter("doc_id IS NOT NULL"), PIECES).join(table.select("doc_id", "text"), "doc_id").collect():
            if r.n_chars == len(r.text or ""):
                assert r.n_tokens == len(model.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.token_counts(nothing, PIECES).count() == 0


def test_token_count_ties():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = np.random.default_rng(11)
    pieces = ["a", "b", "ab", "ba", "aab", "t", "h", "th", "e", "the", "in", "hein", "▁", "▁a", "▁th", "s", "ss", "n", "i"]
    vocab = [("<unk>", 0.0)] + [(p, -float(rng.integers(1, 4))) for p in pieces]
    model = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    count = token_counts.Counter(vocab).count
    for _ in range(2000):
        text = "".join(rng.choice(list("abthein s z日"), 25))
        assert count(text) == len(model.encode(text, add_special_tokens=False).ids)


# Packing


def test_packing_is_valid_and_tight(documents):
    found = packing.pack(packing.pieces(documents, WORD_BPE, 0, 2048)).collect()
    texts = texts_of(documents)
    ids = {d: np.array([*e.ids, 0], "<u4") for d, e in zip(texts, library(WORD_BPE).encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    held, lengths = defaultdict(list), Counter()
    for r in found:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.start == 2048 * r.piece
        held[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    assert lengths == {d: len(i) for d, i in ids.items()}
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(lengths.values()) // 2048) * 1.02 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(2).integers(1, 100, 500)
    capacity = packing.Capacity(tokens=100, documents=4, attention=6000, weights=(1.0, 1.0, 1.0), rule=rule)
    lengths = lengths[lengths**2 <= 6000]
    chosen = packing.best_fit(lengths, capacity)
    for k in range(chosen.max() + 1):
        own = lengths[chosen == k]
        assert 0 < len(own) <= 4 and own.sum() <= 100 and (own**2).sum() <= 6000
    assert packing.best_fit(np.array([6, 5, 5, 4]), packing.Capacity(tokens=10, documents=10, attention=100)).max() == 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), capacity)


def plain_best_fit(lengths, capacity):
    """The same choice, one sequence after another."""
    limits = (capacity.tokens, capacity.documents, capacity.attention)
    scale = [w / m for w, m in zip(capacity.weights, limits, strict=True)]
    left, chosen = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = (lengths[i], 1, lengths[i] ** 2)
        options = []
        for at, room in enumerate(left):
            if all(r >= n for r, n in zip(room, need, strict=True)):
                if capacity.rule == "dot":
                    score = -sum(r * s * n * s for r, n, s in zip(room, need, scale, strict=True))
                else:
                    score = sum(((r - n) * s) ** 2 for r, n, s in zip(room, need, scale, strict=True))
                options.append((score, at))
        if not options:
            left.append(list(limits))
            options = [(0, len(left) - 1)]
        best = min(options)[0]
        chosen[i] = {at for score, at in options if score == pytest.approx(best, rel=1e-12)}, min(options)[1]
        left[chosen[i][1]] = [r - n for r, n in zip(left[chosen[i][1]], need, strict=True)]
    return len(left), left


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents, attention", [(2048, 2048 * 2048), (4, 2048 * 2048), (64, 1_200_000)])
def test_best_fit_beside_a_plain_one(rule, documents, attention):
    rng = np.random.default_rng(11)
    capacity = packing.Capacity(documents=documents, attention=attention, weights=(1.0, 0.3, 0.2), rule=rule)
    for _ in range(5):
        lengths = rng.integers(1, 1000, 150)
        made, _ = plain_best_fit(lengths.tolist(), capacity)
        found = packing.best_fit(lengths, capacity)
        assert len(set(found.tolist())) == made
        for s in set(found.tolist()):
            own = lengths[found == s]
            assert own.sum() <= 2048 and len(own) <= documents and (own**2).sum() <= attention


def test_packing_oddities(tricky, nothing):
    found = packing.pack(packing.pieces(tricky, WORD_BPE, 0, 64, keep_ids=True), packing.Capacity(tokens=64))
    rows = found.collect()
    assert sum(r.piece == 0 for r in rows) == tricky.count()
    assert {len(r.ids) <= 4 * 64 for r in packing.sequences(found).collect()} == {True}
    assert packing.pack(packing.pieces(nothing, WORD_BPE, 0, 64)).count() == 0


# SimHash


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, most):
    """The smallest id reachable from each id, over all pairs."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= most and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def nodes_of(spark, prints):
    return spark.createDataFrame([(signed(p),) for p in sorted(set(prints))], "node long")


def test_simhash_brute_force(documents):
    prints = {d: fingerprint(t) for d, t in texts_of(documents).items()}
    found = simhash.clusters(documents).collect()
    expected = reachable(prints, 3)
    assert {r.id: (r.fp % (1 << 64), r.component_id) for r in found} == {d: (prints[d], expected[d]) for d in prints}


@pytest.mark.parametrize("most, segments", [(3, 2), (12, 4), (7, 3)])
def test_links_have_the_components_of_all_pairs(spark, documents, most, segments):
    prints = sorted({fingerprint(t) for t in texts_of(documents).values()})
    pairs = simhash.links(nodes_of(spark, prints), most, segments).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= most for r in pairs)
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = reachable({signed(p): p for p in prints}, most)
    assert {n: roots.get(n, n) for n in map(signed, prints)} == expected


def test_a_crowded_ball_gives_few_links(spark):
    """10,000 fingerprints, all with the same segment and within three bits of one or another."""
    rng, high, seen = np.random.default_rng(2), [0], {0}
    while len(high) < 10_000:  # each a bit from an earlier one, in the other segment
        value = high[int(rng.integers(len(high)))] ^ 1 << int(rng.integers(32))
        if value not in seen:
            seen.add(value)
            high.append(value)
    prints = [h << 32 | 0x1234 for h in high]
    pairs = simhash.links(nodes_of(spark, prints))
    assert pairs.count() < 20 * len(prints)
    roots = simhash.components(pairs).collect()
    assert len({r.root for r in roots}) == 1 and len(roots) == len(prints) - 1


def test_components_of_a_chain(spark):
    rng = np.random.default_rng(1)
    names = rng.permutation(200)
    edges = [(int(min(a, b)), int(max(a, b))) for a, b in zip(names[:120], names[1:120], strict=False)] + [(int(min(a, b)), int(max(a, b))) for a, b in [(names[150], names[151])]]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = int(min(names[:120]))
    assert {n: r for n, r in found.items() if r == low} == {int(n): low for n in names[:120] if n != low}
    assert len(found) == 120


def test_simhash_oddities(tricky, nothing):
    found = simhash.clusters(tricky).collect()
    assert len(found) == tricky.count()
    assert {r.component_id for r in found if r.fp == 0} == {0}
    near = simhash.near_copies(tricky).collect()
    assert len(near) == tricky.count()
    kept = simhash.keep_one(tricky)
    assert kept.columns == tricky.columns
    assert kept.count() == len({r.component_id for r in near})
    assert {r.component_id for r in near if r.id in (0, 1, 2, 12)} == {0}
    assert {r.component_id for r in near if r.id in (4, 5, 6)} == {4} and len({r.fp for r in near if r.id in (4, 5, 6)}) == 2
    assert simhash.clusters(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


# Mixing


def test_mixing_shares_and_repeats(documents):
    plan = mixing.mix_plan(documents, [5, 2, 1]).collect()
    totals, taken, targets = Counter(), Counter(), {}
    for r in plan:
        assert r["size"] == len(words(r.row.text or "")) and 0 <= r.copies <= 3
        totals[r.row.source] += r["size"]
        taken[r.row.source] += r["size"] * r.copies
        targets[r.row.source] = r.target
    assert sum(targets.values()) == pytest.approx(sum(totals.values()))
    assert all(targets[s] <= 3 * totals[s] + 1e-6 for s in totals)
    again = mixing.mix_plan(documents.repartition(7), [5, 2, 1]).collect()
    assert {(r.id, r.copies) for r in again} == {(r.id, r.copies) for r in plan}
    assert mixing.mix(documents, [5, 2, 1]).count() == sum(r.copies for r in plan)


def test_mixing_targets_by_repeated_sharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 1, None: 300}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    open_, target, left = set(sizes), dict.fromkeys(sizes, 0.0), float(sum(sizes.values()))
    while True:
        trial = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if trial[s] > 3 * sizes[s]}
        if not over:
            target |= trial
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    assert {r.source: pytest.approx(r.target) for r in mixing.source_targets(frame, [5, 2, 1]).collect()} == target


def test_mixing_oddities(tricky, nothing, monkeypatch):
    plan = mixing.mix_plan(tricky, [5, 2, 1])
    assert plan.count() == tricky.count()
    usual = sorted((str(r.id), r.copies) for r in plan.collect())
    assert mixing.mix(tricky, [5, 2, 1]).columns == tricky.columns
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted((str(r.id), r.copies) for r in mixing.mix_plan(tricky, [5, 2, 1]).collect()) == usual
    assert mixing.mix(nothing, [5, 2, 1]).count() == 0


# Quality


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.93 * len(scored)
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)


def test_held_out_labels_teach_nothing(spark, documents, labels):
    turned = labels.withColumn("quality", F.when(quality.in_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(documents, labels) == quality.fit(documents, turned)


def test_quality_oddities(tricky, nothing, labels, spark):
    one_class = spark.createDataFrame([(i, 1) for i in range(10)] + [(None, 0), (3, None)], "doc_id long, quality int")
    model = quality.fit(tricky, one_class)
    rows = quality.scored(tricky, model).collect()
    assert len(rows) == tricky.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(tricky, model).columns == tricky.columns
    assert quality.scored(nothing, quality.fit(nothing, labels)).count() == 0


# Fingerprints


def jaccard(a, b):
    a, b = (Counter(w.lower() for w in words(t)) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0


def test_fingerprints_estimate_weighted_jaccard(documents):
    texts = texts_of(documents)
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    errors, prints = [], {}
    for r in fingerprints.compare_edits(documents).collect():
        text, after = texts[r.id], texts[following[r.id]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
        assert prints.setdefault(text, r.samples) == r.samples
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.11 and len(errors) == 2 * len(texts)


def test_more_samples_bring_the_estimate_closer(spark):
    one, two = "a a a b b c d e f g", "a b b b c c x y z g"
    frame = spark.createDataFrame([(1, one), (2, two)], "key long, text string")
    a, b = (r.samples for r in fingerprints.fingerprints(frame, ["key"], samples=256).orderBy("key").collect())
    assert np.mean([x == y for x, y in zip(a, b, strict=True)]) == pytest.approx(jaccard(one, two), abs=0.1)


def test_fingerprint_oddities(tricky, nothing):
    rows = fingerprints.compare_edits(tricky, samples=4).collect()
    assert len(rows) == tricky.count() and all(0 <= r.near_next <= 1 for r in rows)
    assert {tuple(r.samples) for r in rows if r.n_chars == 0} == {(fingerprints.NO_TERM,) * 4}
    single = tricky.filter("doc_id = 14")
    assert [r.near_next for r in fingerprints.compare_edits(single, samples=4).collect()] == [1.0]
    assert fingerprints.compare_edits(nothing, samples=4).count() == 0


# Personal data


def luhn(number):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(re.sub("[^0-9]", "", number))))) % 10 == 0


def treated(spark, texts, key="k"):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.kinds) for r in pii.pseudonymise(frame, key).orderBy("row.doc_id").collect()]


def test_pseudonyms_keep_format_and_validity(spark):
    cards = ["4845168114407329", "4111-1111-1111-1111", "3782 822463 10005"]
    for before, (after, kinds) in zip(cards, treated(spark, cards), strict=True):
        assert kinds == ["card"] and after != before and luhn(after) and re.sub("[0-9]", "9", after) == re.sub("[0-9]", "9", before)
    (iban, kinds), (date, _), (ssn, _), (ip, _) = treated(spark, ["DE89 3704 0044 0532 0130 00", "2001-12-31", "123-45-6789", "97.51.17.173"])
    moved = iban.replace(" ", "")
    assert kinds == ["iban"] and int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1 and iban[:2] == "DE"
    import datetime

    assert datetime.date.fromisoformat(date) and date != "2001-12-31"
    assert not re.search("^(000|666|9..)-|-00-|-0000$", ssn) and ssn != "123-45-6789"
    assert all(0 <= int(o) <= 255 for o in ip.split("."))


def test_equal_values_stay_linked_and_others_apart(spark):
    texts = ["a 4845168114407329 b", "4845168114407329 4929348385146306", "x@mail.org y@mail.org x@mail.org"]
    first, second, third = (t for t, _ in treated(spark, texts))
    assert first.split()[1] == second.split()[0] != second.split()[1]
    assert third.split()[0] == third.split()[2] != third.split()[1] and third.endswith("@mail.org")
    assert treated(spark, texts[:1], "other key")[0][0] != first


def test_no_two_dates_share_a_pseudonym(spark):
    """All days of some years in each way of writing that says which they are."""
    days = spark.range(7670).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    written = [F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "MM/dd/yyyy"), F.date_format("d", "dd.MM.yyyy"), F.when(F.day("d") > 12, F.date_format("d", "dd/MM/yyyy"))]
    frame = days.select(F.explode(F.array_compact(F.array(*written))).alias("text")).withColumn("doc_id", F.monotonically_increasing_id())
    done = pii.pseudonymise(frame, "k").select("row.text", F.col("text").alias("new"), "kinds")
    assert done.filter(F.size("kinds") != 1).count() == 0
    assert done.select("new").distinct().count() == done.count()
    kept = done.filter("regexp(new, '^(1[3-9]|2[0-9]|3[01])/') != regexp(text, '^(1[3-9]|2[0-9]|3[01])/')")
    assert kept.count() == 0  # the day is first where it was


def test_clean_text_is_left_alone(spark):
    clean = ["no digits", "CC BY 4.0. 1.2.3", "4845168114407328 isn't valid, 300.1.1.1 neither, nor 2020-02-31 or 000-12-3456", "", None, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    assert [t for t, _ in treated(spark, clean)] == clean


def test_the_network_is_a_permutation(spark):
    pairs = spark.range(0, 1000).select(F.format_string("%03d", "id").alias("v"))
    made = pairs.select("v", pii.permuted_text(F.col("v"), lambda i: F.lit(True), "k", "t").alias("p"))
    assert made.select("p").distinct().count() == 1000 and made.filter("v = p").count() < 20


def test_planted_data_of_the_corpus(documents):
    cards = re.compile(r"(?<![0-9A-Za-z.])[0-9]{16}(?![0-9A-Za-z])")
    mails = re.compile(r"[a-z]+\.[0-9]+@mail[0-9]\.example\.com")
    rows = pii.pseudonymise(documents, "k").select("row.*", F.col("text").alias("treated")).collect()
    for r in rows:
        for found in [c for c in cards.findall(r[1] or "") if luhn(c)] + mails.findall(r[1] or ""):
            assert found not in r.treated
        if not re.search("[0-9@]", r[1] or ""):
            assert r.treated == r[1]


def test_pseudonym_oddities(tricky, nothing):
    rows = pii.pseudonymise(tricky, "k")
    assert rows.count() == tricky.count() and rows.filter("row.text IS NULL AND text IS NOT NULL").count() == 0
    assert pii.pseudonymise(nothing, "k").count() == 0
