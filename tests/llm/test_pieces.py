"""Pieces of a batch are learned once each, whatever texts they stand in."""

import public_tokenizers

from areaflow.llm.token_files import PieceEncoder


def test_a_batch_asks_for_each_new_piece_once(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as text:
        pieces = PieceEncoder(text.read())
    asked = []
    learn = pieces.learn
    monkeypatch.setattr(pieces, "learn", lambda new: asked.append(sorted(new)) or learn(new))
    texts = ["one two one two three", "", "two three 4, four\n"]
    first = pieces.encode(texts)
    assert pieces.encode(texts[::-1]) == first[::-1]
    assert len(asked[0]) == len(set(asked[0])) > 4 and sum(asked[1:], []) == []
    want = [e.ids for e in pieces.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(memoryview(data).cast(pieces.code)) for data in first] == want
