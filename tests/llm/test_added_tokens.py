"""Added tokens' strings in texts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from furrow.llm.tokens import encoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_get_their_ids(name):
    path = public_tokenizers.path(name)
    texts = ["a<|endoftext|>b c", "<|endoftext|>", "plain words", "", "two  <|startoftext|> spaces \n<|endoftext|>", "x <|ENDOFTEXT|> y", "last words"]
    made = [own[:-1].tolist() for _, ids, counts in encoder(path).blocks(pa.array(texts), 7) for own in np.split(ids, np.cumsum(counts)[:-1])]
    assert made == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
