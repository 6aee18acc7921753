"""Cross-tokenizer alignment beside a version that walks every document's tokens and keeps every link."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from conftest import DATA  # noqa: F401

from furrow.llm import alignment, units
from furrow.llm.registry import QUERIES

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SMALL = "/root/testdata/sf0.001"
ODD = [
    " a", "a ", "a  b", "\n x", "x \ny", "x\n y", "a  b", "▁ x", "a▁b", "<|endoftext|> <s> </s>", "a\r b;\r c", "\x85 z", "x　y", "​ q", "don't  can't 's",
    "\x1c x", " ", "\n", "nul\x00 nul", "日本語 テキスト 漢字", "😀 😀😀 é", "the same", "the same",
]


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def brute(texts, models):
    """What align gives for each (row, text), by single steps."""
    of_a, of_b = units.byte_level(A).bytes, units.pieces(B).bytes
    walked, counts = {}, Counter()
    for row, text in texts:
        a = models[0].encode(" " + text, add_special_tokens=False).ids if text else []
        b = models[1].encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not a or b"".join(of_a[i] for i in a) != whole or b"".join(of_b[i] for i in b) != whole:
            walked[row] = ([], [], [], [])
            continue
        i = j = 0
        end_a, end_b, group_a, group_b, groups, links = len(of_a[a[0]]), len(of_b[b[0]]), [a[0]], [b[0]], [], []
        while True:
            links.append((a[i], b[j]))
            if end_a == end_b:
                groups.append(f"{','.join(map(str, group_a))}|{','.join(map(str, group_b))}")
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                end_a, end_b, group_a, group_b = end_a + len(of_a[a[i]]), end_b + len(of_b[b[j]]), [a[i]], [b[j]]
            elif end_a < end_b:
                i += 1
                end_a, group_a = end_a + len(of_a[a[i]]), [*group_a, a[i]]
            else:
                j += 1
                end_b, group_b = end_b + len(of_b[b[j]]), [*group_b, b[j]]
        walked[row] = (a, b, groups, links)
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return {
        row: (len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for row, (a, b, groups, links) in walked.items()
    }


def plain(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_query_beside_brute_force(spark, documents, models):
    expected = brute([(r.doc_id, r.text) for r in documents.collect()], models)
    assert {r.doc_id: plain(r) for r in QUERIES["op13_alignment"](spark, SMALL).collect()} == expected


@pytest.mark.parametrize("chunk_bytes", [200, alignment.CHUNK_BYTES])
def test_oddities(spark, tricky, nothing, models, chunk_bytes):
    texts = [r.text for r in tricky.collect()] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: plain(r) for r in alignment.align(docs, A, B, chunk_bytes=chunk_bytes).collect()} == brute(enumerate(texts), models)
    found = alignment.align(tricky, A, B, chunk_bytes=chunk_bytes).collect()  # repeated and null ids, clashing names
    assert Counter((r.doc_id, r.n_a) for r in found) == Counter((r.doc_id, len(models[0].encode(" " + r.text).ids) if r.text else 0) for r in tricky.collect())
    assert alignment.align(nothing, A, B).count() == 0
    assert [plain(r) for r in alignment.align(docs.filter("doc_id < 2"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_salted_stripes_give_the_same(spark, documents, monkeypatch):
    one = Counter(alignment.align(documents, A, B, chunk_bytes=1 << 16).collect())
    monkeypatch.setattr(alignment, "SALT_CHUNKS", 2)
    assert Counter(alignment.align(documents, A, B, chunk_bytes=1 << 16).collect()) == one
