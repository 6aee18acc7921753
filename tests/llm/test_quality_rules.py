"""Quality rules beside one document at a time, and what they keep and reject of labelled documents."""

import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from conftest import DATA  # noqa: F401

from furrow.llm import quality_rules, registry
from furrow.llm.quality_rules import Rules

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACES = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def model():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def figures(text, model):
    ids = model.encode(text) if text else []
    if not ids:
        return None
    fallen = sum(model.is_byte(i) and int(model.id_to_piece(i)[3:5], 16) not in SPACES for i in ids)
    counts = Counter(ids).values()
    return len(ids), len(text) / len(ids), fallen / len(ids), max(math.log2(len(ids)) - sum(c * math.log2(c) for c in counts) / len(ids), 0)


def verdicts(rows, model, rules):
    """base_failed and kept of each (row, band, text)."""
    found = {row: figures(text, model) for row, _, text in rows}
    groups = defaultdict(set)
    for row, band, _ in rows:
        if found[row]:
            groups[band, int(math.log2(found[row][0]))].add(tuple(round(f, 9) for f in found[row][1:]))
    limits = {}
    for key, values in groups.items():
        if len(values) >= rules.least_texts:
            for k, least in enumerate((rules.fertility, rules.byte_share, rules.entropy)):
                ordered = sorted(v[k] for v in values)
                low, high = (ordered[max(0, math.ceil(q * len(ordered)) - 1)] for q in (0.25, 0.75))
                spread = rules.width * max(high - low, least)
                limits[key, k] = low - spread - 1e-9, high + spread + 1e-9
    result = {}
    for row, band, text in rows:
        n, *_, repeated = base(text)
        failed = n < rules.least_words or 100 * repeated > rules.most_repeated * n
        key = (band, int(math.log2(found[row][0]))) if found[row] else None
        inside = all((key, k) not in limits or limits[key, k][0] <= found[row][k + 1] <= limits[key, k][1] for k in range(3))
        result[row] = failed, not failed and inside
    return result


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_beside_single_documents(spark, model, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()
    expected = verdicts([(r.doc_id, r.lang, r.text) for r in rows], model, Rules())
    found = registry.QUERIES["op11_quality_rules"](spark, f"/root/testdata/sf{sf}").collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found} == {r.doc_id: base(r.text) for r in rows}
    assert {r.doc_id: (r.base_failed, r.kept) for r in found} == expected


def test_good_documents_stay_and_bad_ones_go(spark):
    found = registry.QUERIES["op11_quality_rules"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    good, bad = ([r for r in found if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) > 0.965 * len(good)  # the base rules alone take 2.3 %
    assert sum(r.kept for r in good) > 0.99 * sum(not r.base_failed for r in good)
    assert sum(not r.kept for r in bad) > 0.9 * len(bad)


def test_oddities(spark, tricky, nothing, model, monkeypatch):
    rows = tricky.collect()
    rules = Rules(least_texts=1, width=0.1)
    found = quality_rules.judge(tricky, MODEL, rules).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == sorted((r.doc_id is None, r.doc_id, *base(r.text)) for r in rows)
    numbered = [(k, r.lang, r.text) for k, r in enumerate(rows)] + [(100, "en", "again and again\nagain and again\n \nagain and again"), (101, None, "a b c d e a b c d e f g h i j k l m n o p")]
    df = spark.createDataFrame(numbered, "doc_id long, lang string, text string")
    expected = verdicts(numbered, model, rules)
    assert {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(df, MODEL, rules).collect()} == expected
    monkeypatch.setattr(quality_rules, "MOST_BANDS", 0)
    monkeypatch.setattr(quality_rules, "BLOCK_BYTES", 30)
    assert {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(df, MODEL, rules).collect()} == expected
    assert quality_rules.judge(nothing, MODEL).count() == 0


def test_copies_make_no_band_of_their_own(spark, documents):
    docs = documents.filter("lang = 'en'").select("doc_id", "text", "lang")
    alone = {r.doc_id: r.kept for r in quality_rules.judge(docs, MODEL).collect()}
    copies = docs.orderBy("doc_id").limit(1).selectExpr("explode(sequence(100000, 102000)) AS doc_id", "text", "lang")
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs.union(copies), MODEL).collect() if r.doc_id < 100000} == alone
