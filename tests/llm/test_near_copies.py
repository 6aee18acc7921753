"""The pipeline's near-deduplication beside brute-force Jaccard similarity."""

from itertools import combinations

import numpy as np
import pytest
from conftest import DATA  # noqa: F401

import corpus_pipeline
from furrow.llm import simhash


def sets_of(texts):
    out = {}
    for doc, text in texts.items():
        words = text.lower().encode().split()
        out[doc] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return out


def kept_by_brute_force(texts):
    own, root = sets_of(texts), {d: d for d in texts}
    for a, b in combinations(sorted(texts), 2):
        both = len(own[a] & own[b])
        if 5 * both >= 4 * (len(own[a]) + len(own[b]) - both):
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return set(root.values())


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return out


def test_near_copies_beside_jaccard(spark):
    rng, texts = np.random.default_rng(5), {}
    for _ in range(60):
        words = [f"w{v}" for v in rng.integers(0, 5000, 300)]
        for changes in (0, 2, 4, 6, 8, 12):
            texts[len(texts)] = " ".join(edited(rng, words, changes))
    chain = [f"c{v}" for v in range(300)]
    for k in range(6):  # each like the next, the ends unlike
        texts[len(texts)] = " ".join([*[f"x{v}" for v in range(25 * k)], *chain[25 * k :]])
    texts |= {len(texts): "", len(texts) + 1: " \n ", len(texts) + 2: "three short words"}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()}
    assert kept == kept_by_brute_force(texts)


def test_corpus_beside_jaccard(spark, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents, DATA).collect()} == kept_by_brute_force(texts)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingle_length_is_a_parameter(size):
    assert len(simhash.shingle_hashes("a b c d e f g", size)) == 8 - size


@pytest.mark.parametrize("words, similarity, least", [(300, 0.8, 0.95), (300, 0.9, 0.99), (40, 0.8, 0.9)])
def test_balls_find_pairs_of_the_least_similarity(words, similarity, least):
    """The share of single pairs at just that similarity which share a value of a segment and pass the distance."""
    rng, hits, pairs = np.random.default_rng(7), 0, 400
    shared = round(2 * words * similarity / (1 + similarity))
    template = simhash.likely_differences()
    for _ in range(pairs):
        drawn = rng.integers(0, 1 << 64, 2 * words - shared, dtype=np.uint64)
        prints = [simhash.wide_fingerprint(drawn[:words]), simhash.wide_fingerprint(drawn[words - shared :])]
        held = []
        for fp, weak in prints:
            values = fp.view("<u4")
            held.append({(k, int(values[k]) ^ sum(1 << int(weak[k][i]) for i in subset)) for k in range(8) for subset in template})
        distance = sum(int(a ^ b).bit_count() for a, b in zip(prints[0][0], prints[1][0], strict=True))
        hits += bool(held[0] & held[1]) and distance <= simhash.MAX_DISTANCE
    assert hits >= least * pairs


def test_short_texts_link_exactly(spark):
    """Every pair of sets of up to 25 shingles at 0.8 or more is found, whatever the edit, beside a line that many share."""
    rng, texts = np.random.default_rng(11), {}
    for words in range(1, 32):
        for _ in range(6):
            own = [f"w{v}" for v in rng.integers(0, 1 << 40, words)]
            pair = [own, own[:-1], own[1:], [*own, "more"], [*own[:-1], "other"], ["other", *own[1:]], [*own[:3], "put", "in", *own[3:]], [*own, "a", "b", "c"]]
            for k in rng.choice(len(pair), 2, replace=False):
                texts[len(texts)] = " ".join(pair[k])
    for k in range(400):  # alike in a common line alone
        texts[len(texts)] = f"licensed under the terms of the common licence v{k} x{k} y{k}"
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == kept_by_brute_force(texts)


def test_near_copies_leave_only_what_goes(spark, documents, monkeypatch, tmp_path):
    monkeypatch.setattr("furrow.session.shared_folder", lambda _: f"file://{tmp_path}")
    assert simhash.keep_one(documents).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if not p.name.startswith(".")}
    assert left <= {"near-copies", "repeated-ids", "bloom", "spared"}


def test_texts_like_none_are_not_paired_with_a_large_group(spark, monkeypatch):
    """Texts that share two thirds with all of a group make no pairs with its members, and no link is lost."""
    rng, texts = np.random.default_rng(13), {}
    words = [f"w{v}" for v in range(60)]
    for _ in range(60):
        texts[len(texts)] = " ".join(edited(rng, words, 1))
    for _ in range(60):  # an edit that two texts have, and one of their own
        both = edited(rng, words, 1)
        for _ in range(2):
            texts[len(texts)] = " ".join(edited(rng, both, 2))
    seen = {}
    plain = simhash.materialize

    def noted(df, label):
        out = plain(df, label)
        seen[label] = seen.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", noted)
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == kept_by_brute_force(texts)
    assert seen["other-pairs"] < len(texts) * 10
    assert seen["asked-places"] < len(texts) * 15


def test_driver_plans_stay_small(spark, documents, monkeypatch):
    """No plan of near_copies has many joins, and components that are stars already take no round."""
    joins, labels = {}, []
    plain = simhash.materialize

    def noted(df, label):
        labels.append(label)
        joins[label] = max(joins.get(label, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return plain(df, label)

    monkeypatch.setattr(simhash, "materialize", noted)
    simhash.near_copies(documents).count()
    assert max(joins.values()) <= 7, joins
    assert labels.count("large-star") <= 8, labels
    labels.clear()
    stars = spark.createDataFrame([(1, 2), (3, 1), (4, 9), (5, 5), (2, 1)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(stars).collect()} == {(2, 1), (3, 1), (9, 4)}
    assert labels == ["links"]
