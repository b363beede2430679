"""New chunks that are words, words with punctuation, or neither, against the library on whole texts."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sparkforest.llm import tokens


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_new_chunks_of_all_kinds(name, spaced):
    texts = ["zorbix zorbix, quuxel. quuxel! zorbix", "a1 b2, ,,, x-y zorbix's mirlo: mirlo", "mirlo; plon... plon 'plon' ünßer, ünßer", "", "zorbix"]
    library = Tokenizer.from_file(P.path(name))
    library.encode_special_tokens = True
    encoder = tokens.library_encoder(P.path(name), spaced)
    for part in (texts[:2], texts[2:], texts):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in part]
    assert len(encoder.chunks.unique()) == len(encoder.chunks) == len(encoder.starts) - 1
