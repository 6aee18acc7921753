"""The encoder's memory of words."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from furrow.llm.tokens import Encoder, pieces


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, plain):
        self.plain, self.given = plain, 0

    def __getattr__(self, name):
        return getattr(self.plain, name)

    def encode_batch_fast(self, texts, **options):
        self.given += sum(map(len, texts))
        return self.plain.encode_batch_fast(texts, **options)


def test_words_of_earlier_blocks_are_not_encoded_again():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.plain = counting = Counting(encoder.plain)
    texts = [" ".join(f"w{k}x{i}" for i in range(50_000)) for k in range(6)]
    first = [list(encoder.blocks(pa.array([t]), 2)) for t in texts]
    counting.given = 0
    again = list(encoder.blocks(pa.array([texts[0]]), 2))
    assert counting.given == 0
    assert [a.tolist() for a in again[0][1:]] == [a.tolist() for a in first[0][0][1:]]
    assert again[0][1].tolist() == [*counting.plain.encode(texts[0], add_special_tokens=False).ids, 2]


def test_words_that_joined_ids_dont_tell_apart_are_encoded_alone():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.opens[:] = False  # no group is clear
    words = [" one", " two,", "three", " \n", " four's", " é x"] + [f" word{k}" for k in range(200)]
    found = encoder.encode_words(pa.array(words))
    for k, w in enumerate(words):
        assert found.of(np.array([k])).tolist() == encoder.plain.encode(w, add_special_tokens=False).ids


def test_words_of_known_pieces_are_not_encoded_again():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.plain, encoder.bare = plain, bare = Counting(encoder.plain), Counting(encoder.bare)
    list(encoder.blocks(pa.array(["Some words , . ) 17 Élan\nand\nmore\nwords\nÉlan"]), 2))
    plain.given = bare.given = 0
    text = "Some words, more\nwords). Élan.\nÉlan17 words\nand words,\nÉlan"
    made = [ids.tolist() for _, ids, _ in encoder.blocks(pa.array([text]), 2)]
    assert made == [[*plain.encode(text, add_special_tokens=False).ids, 2]]
    # Only these are new: " more", ").", "." and "17" without a space, and " Élan".
    assert plain.given + bare.given < 30


def test_words_are_cut_where_the_library_cuts_them():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    signs = ["a", "The", "é", "ſ", "×", "÷", "ƀ", "你", "«", "'s", "'", "7", "½", "%", "<|", "\n", "\n\n", "\t", "\x00", "\x85", " ", "́", "😀", "Ġ", "_", " "]
    words = sorted({p + a + b + c for p in ("", " ") for a in signs for b in signs for c in ("", "x", "\n", "9", "'", "!")} | {"", " "})
    found = encoder.encode_words(pa.array(words))
    made = encoder._ids_of(pa.array(words))
    for k, own in enumerate(encoder.plain.encode_batch(words, add_special_tokens=False)):
        assert found.of(np.array([k])).tolist() == made.of(np.array([k])).tolist() == own.ids, words[k]
    parts, counts = pieces(pa.array([" words,", " l'eau", " one\nTwo3).", " a×b", "", " \n"]))
    assert parts.to_pylist() == [" words", ",", " l'eau", " one", "\n", "Two", "3", ").", " a×b", "", " \n"] and counts.tolist() == [2, 1, 5, 1, 1, 1]
