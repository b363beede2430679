"""What encoding costs, beside the ids."""

import public_tokenizers as P
from tokenizers import Tokenizer

from sparkforest.llm import tokens


def test_a_slice_looks_into_the_table_once(monkeypatch):
    path, looks, look = P.path("byte_bpe_50k.json"), [], tokens.pc.index_in
    monkeypatch.setattr(tokens, "_loaded", {})
    monkeypatch.setattr(tokens.pc, "index_in", lambda *a, **k: looks.append(1) or look(*a, **k))
    encoder, library = tokens.library_encoder(path, True), Tokenizer.from_file(path)
    for texts in (["one two, three.", "two two) (four) 5.0!", ""], ["(one) three? two's é, é ...", "four, . one"], ["one two, three.", "x"]):
        looks.clear()
        (ids, ends), = encoder.slices(texts)
        assert len(looks) == 1
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
